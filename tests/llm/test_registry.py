"""Every corpus query with SQL gives the rows that DuckDB gives for that SQL on the smallest tables."""

import duckdb
import pytest

from gristmill.llm import registry
from tests.test_queries import DATA, TABLES, pytestmark, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = registry.queries()[name](spark, DATA)
    got = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())
