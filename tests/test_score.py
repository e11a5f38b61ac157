"""Means and deviations that do not depend on the order of the rows."""

import itertools
import random
import statistics

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gristmill import catalog
from gristmill.operators import score


def test_means_do_not_depend_on_the_order_of_rows(spark):
    values = [0.1, 0.2, 0.3]  # their sum is 0.6, as doubles in some orders a little more
    orders = list(itertools.permutations(values))
    assert len({a + b + c for a, b, c in orders}) > 1
    rows = [(k, v) for k, o in enumerate(orders) for v in o]
    df = spark.createDataFrame(rows, "k long, v double").coalesce(1)
    assert {r["m"] for r in df.groupBy("k").agg(score.mean("v").alias("m")).collect()} == {0.6 / 3}
    odd = spark.createDataFrame([("big", 1e300), ("big", 3e300), ("inf", float("inf")), ("nan", float("nan")), ("nan", 1.0), ("none", None), ("gap", 2.5), ("gap", None), ("long", 1 / 3)], "k string, v double")
    got = {r["k"]: r["m"] for r in odd.groupBy("k").agg(score.mean("v").alias("m")).collect()}
    assert got.pop("nan") != got.get("nan") and got == {"big": 2e300, "inf": float("inf"), "none": None, "gap": 2.5, "long": 1 / 3}


def test_moments_of_groups(spark):
    rows = [("a", v) for v in (3.5, 1.25, 9.0)] + [("b", 4.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    own = score.in_order(df, ["k"], "v", "x")
    m, s = score.moments(F.col("x"))
    got = {r["k"]: (r["x"], r["m"], r["s"]) for r in own.select("k", "x", m.alias("m"), s.alias("s")).collect()}
    assert got["a"] == ([1.25, 3.5, 9.0], 13.75 / 3, pytest.approx(statistics.stdev([1.25, 3.5, 9.0]))) and got["b"] == ([4.0], 4.0, None) and got["c"] == ([], None, None)


def test_means_at_a_bound_fall_as_in_the_sql(spark, tmp_path):
    """Values of each question that come to 50 exactly on the average, and as doubles to a little more in some orders."""
    r = random.Random(1)
    rows = []
    for user in range(60):
        for question in range(12):
            cents = [r.randrange(10_000) for _ in range(5)]
            cents.append(5000 * 6 - sum(cents))
            rows += [(user, "view", c / 100, f'{{"k": {question}}}') for c in cents]
    r.shuffle(rows)
    columns = dict(zip(("user_id", "event_type", "value", "props"), map(list, zip(*rows, strict=True)), strict=True))
    pq.write_table(pa.table({"event_id": list(range(len(rows))), **columns}), tmp_path / "events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    asked = "SELECT model, above, least FROM ({}) ORDER BY 1"
    want = con.execute(asked.format(catalog.oracle_sql()["row_statistics"])).fetchall()
    got = catalog.queries()["row_statistics"](spark, str(tmp_path)).select("model", "above", "least").orderBy("model").collect()
    assert [tuple(v) for v in got] == want and any(above for _, above, _ in want)


def test_means_in_order_of_groups(spark):
    rows = [("a", 3, 0.3), ("a", 1, 0.1), ("a", 2, 0.2), ("b", 1, 0.3), ("b", 2, 0.2), ("b", 3, 0.1), ("gap", 2, None), ("gap", 1, 2.5), ("none", 1, None), (None, 1, 4.0)]
    df = spark.createDataFrame(rows, "k string, at long, v double").repartition(3)
    got = {v["k"]: v["v"] for v in score.mean_in_order(df, ["k"], "v", "at").collect()}
    assert got == {"a": (0.1 + 0.2 + 0.3) / 3, "b": (0.3 + 0.2 + 0.1) / 3, "gap": 2.5, "none": None, None: 4.0} and got["a"] != got["b"]
