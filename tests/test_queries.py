"""Every registered query with SQL gives the rows that DuckDB gives for that SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from gristmill import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v + 0.0:.7g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = catalog.queries()[name](spark, DATA)
    got = sql.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())


def test_queries_without_sql_are_held_to_invariants():
    """tests/test_invariants.py recomputes what must hold of each of them."""
    with open(os.path.join(os.path.dirname(__file__), "test_invariants.py")) as f:
        text = f.read()
    assert all(f'"{name}"' in text for name in set(catalog.queries()) - set(catalog.oracle_sql()))
