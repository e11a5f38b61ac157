"""What queries may not do, because it would grow faster than their input."""

import os

import numpy as np
from pyspark.sql import functions as F


from gristmill import catalog
from gristmill.operators import bank, drawn, impute, latent, predict
from gristmill.operators.metric import MetricIndex
from gristmill.plans import kernels

DATA = os.environ.get("GRISTMILL_DATA", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_conflicts_do_not_multiply_rows(spark):
    assert "Expand" not in plan(catalog.queries()["conflict_samples"](spark, DATA))


def test_ranks_of_draws_are_those_of_a_sorted_table(spark, monkeypatch):
    monkeypatch.setattr(drawn, "RANGE", 8)
    rows = [(k, float(k * 37 % 50) * 40) for k in range(-3, 60)] + [(7, 12.0), (70, None), (71, float("nan")), (72, 280.0), (20090, 280.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k long, v double")
    held, n = drawn.tables(200.0), 30
    with_key = [r for r in rows if r[0] is not None]
    keys = np.array([k for k, _ in with_key])
    x = drawn.draws(keys, np.array([np.inf if v is not None and v != v else np.nan if v is None else v for _, v in with_key]), n, *held)
    want = {}
    for j in range(n):
        order = sorted(range(len(keys)), key=lambda i: (np.isnan(x[i, j]), -x[i, j] if x[i, j] == x[i, j] else 0, keys[i]))
        for place, i in enumerate(order):
            want.setdefault(keys[i], []).append(place + 1)
    got = {r["k"]: r["ranks"] for r in drawn.ranks(df, "k", "v", n, 200.0).collect()}
    assert got.pop(None) == [len(rows)] * n
    assert got == {k: sorted(v) for k, v in want.items()}


def test_ranks_of_draws_need_no_window(spark):
    assert "Window" not in plan(catalog.queries()["rank_stability"](spark, DATA))


def test_later_visits_give_only_rows_within_the_bound(spark):
    x = np.random.default_rng(1).normal(size=(200, 3)).tolist()
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k long, v array<double>")
    index = MetricIndex(df, "k", "v", pivots=1)
    visits = df.where("k < 20").select(F.col("k").alias("query"), F.col("v").alias("at"), F.lit(0).alias("part"), F.lit(0.5).alias("bound"))
    got = {(r["query"], r["key"]) for r in index._search(visits, 50).collect()}
    v = np.array(x)
    assert got == {(a, int(b)) for a in range(20) for b in np.flatnonzero(np.sqrt(((v - v[a]) ** 2).sum(1)) <= 0.5) if a != b}


def test_local_fits_come_in_batches(spark):
    df = spark.createDataFrame([(k, float(k % 7), float(k * k % 11), float(k)) for k in range(60)], "k long, a double, b double, y double")
    got = predict.local_predictions(df, df, "k", ["a", "b"], "y")
    assert plan(got).startswith("MapInPandas") and got.count() == 60
    assert "MapInPandas" not in plan(predict.out_of_fold(df, "k", ["a", "b"], "y"))  # it is told once, however often it is read


def test_held_out_errors_join_nothing(spark):
    rows = [(k, *[None if (k * 7 + c) % 5 == 0 else float((k * (c + 3)) % 17 + k % 3 * c) for c in range(3)]) for k in range(120)]
    df, columns = spark.createDataFrame(rows, "k long, a double, b double, c double"), ["a", "b", "c"]
    got = impute.held_out_errors(df, "k", columns, folds=2)
    assert "Join" not in plan(got)
    errors = {c: [] for c in columns}
    for f in range(2):
        fold = lambda c: F.pmod(F.xxhash64("k", F.lit(c)), F.lit(2)) == f  # noqa: E731, B023
        cells = impute.filled(df.select("k", *[F.when(~fold(c), F.col(c)).alias(c) for c in columns]), "k", columns)
        value = {(r["k"], r["column"]): r["value"] for r in cells.collect()}
        for c in columns:
            errors[c] += [abs(r[c] - value[r["k"], c]) for r in df.where(fold(c) & F.col(c).isNotNull()).collect()]
    assert {r["column"]: (r["n"], round(r["mae"], 9)) for r in got.collect()} == {c: (len(e), round(sum(e) / len(e), 9)) for c, e in errors.items()}


def test_sparse_parts_are_stored(spark):
    assert "Aggregate" not in plan(kernels.sparse_parts(spark, DATA))


def test_words_of_rates_are_found_once(spark):
    assert plan(catalog.queries()["shape_rates"](spark, DATA)).count(r"\b\w+\b") == 1


def test_sums_over_arrays_come_straight_from_arrow(spark, monkeypatch):
    """No pass over a matrix makes an object a row."""
    df = spark.createDataFrame([(k, [float(k), float("nan") if k % 3 else 2.0], None if k % 2 else 1.0) for k in range(50)], "k long, x array<double>, y double").repartition(3)
    monkeypatch.setattr(type(df), "mapInPandas", None)
    got = latent.totals(df, lambda x, y: np.array([*np.nansum(x, 0), np.nansum(y), len(x), x.shape[1] * (len(x) > 0)]), 5)
    assert got[:4].tolist() == [1225.0, 34.0, 25.0, 50.0]
    assert bank.Wide(df.selectExpr("double(k) AS a", "y"), ["a", "y"]).sums(lambda x: np.nansum(x, 0), 2).tolist() == [1225.0, 25.0]
