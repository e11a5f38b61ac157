"""Ratings, imputation and calibration against plain versions and published values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import combine, explore, impute, predict, rate


def test_skill_update_gives_the_published_values():
    start = (25.0, 25 / 3)
    beta, tau = start[1] / 2, start[1] / 100
    margin = rate.quantile(0.55) * np.sqrt(2) * beta
    a, b = rate.skill_update(start, start, False, margin, beta, tau)
    assert np.allclose([*a, *b], [29.396, 7.171, 20.604, 7.171], atol=1e-3)
    a, b = rate.skill_update(start, start, True, margin, beta, tau)
    assert np.allclose([*a, *b], [25, 6.458, 25, 6.458], atol=1e-3)


def test_ratings_and_pairs(spark):
    battles = [("i", k, "x", "y", 5, 1) for k in range(5)] + [("i", 10 + k, "y", "x", 1, 5) for k in range(5)] + [("i", 99, "x", "y", 1, 0)]
    paired = rate.paired_results(spark.createDataFrame(battles, "item string, seq long, model_a string, model_b string, margin_a long, margin_b long"))
    assert [tuple(r) for r in paired.orderBy("i").select("i", "margin_1", "margin_2", "result").collect()] == [(k, 10, 2, "model_1") for k in range(1, 6)]
    got = {r["model"]: r for r in rate.skill_ratings(paired, "item").collect()}
    assert got["x"]["mu"] > 25 > got["y"]["mu"] and got["x"]["games"] == 5 and got["x"]["sigma"] < 25 / 3
    s = {r["model"]: r["strength"] for r in rate.bradley_terry(paired, "item").collect()}
    assert s["x"] == pytest.approx(-s["y"]) and s["x"] > 0
    assert rate.skill_ratings(paired.limit(0), "item").count() == 0


def test_moments_give_the_regression_of_complete_rows(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 2))
    y = 3 + x @ [2.0, -1.0] + 0.1 * r.normal(size=300)
    rows = [(k, float(a), float(b) if k % 4 else None, float(t) if k % 7 else None) for k, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double")
    models = impute.fitted(df, ["a", "b", "y"], 2)
    best, loo = models["y"][0]
    assert best.predictors == ["a", "b"] and np.allclose(best.beta / best.sd, [2, -1], atol=0.05) and loo == pytest.approx(0.01, abs=0.005)
    keep = np.array([bool(k % 4 and k % 7) for k in range(300)])
    z = (x[keep] - best.mean) / best.sd
    h = np.einsum("ij,jk,ik->i", z, np.linalg.inv(z.T @ z + best.penalty * np.eye(2)), z) + 1 / keep.sum()
    e = (y[keep] - best.level - z @ best.beta) / (1 - h)
    assert loo == pytest.approx((e * e).mean(), rel=1e-6)
    cells = impute.filled(df, "k", ["a", "b", "y"])
    assert cells.count() == 900 and cells.where("value is null").count() == 0
    seen = cells.where("origin = 'observed'")
    assert seen.where("sigma2 != 0").count() == 0 and seen.count() == df.select(F.count("a") + F.count("b") + F.count("y")).first()[0]
    t = {r["k"]: r["n_imputed"] for r in impute.trajectory(cells, "k").collect()}
    assert t[28] == 2 and t[1] == 0
    drawn = impute.coherent(cells, "k", ["a", "b", "y"], 2)
    assert drawn.join(seen.select("k", "column", F.col("value").alias("v")), ["k", "column"]).where("value != v").count() == 0


def test_columns_without_values_or_partners(spark):
    df = spark.createDataFrame([(k, float(k) if k % 2 else None, None) for k in range(8)], "k long, a double, b double")
    cells = {(r["k"], r["column"]): (r["value"], r["origin"]) for r in impute.filled(df, "k", ["a", "b"]).collect()}
    assert cells[0, "a"] == (4.0, "median") and cells[0, "b"] == (None, "median") and cells[1, "a"] == (1.0, "observed")


def test_frontier_equals_the_definition(spark):
    r = np.random.default_rng(3)
    pts = [(k, int(a), int(b)) for k, (a, b) in enumerate(r.integers(0, 25, (300, 2)))]
    got = {x["k"] for x in combine.frontier(spark.createDataFrame(pts, "k long, c int, s int"), "c", "s").collect()}
    want = {k for k, c, s in pts if not any(c2 <= c and s2 >= s and (c2 < c or s2 > s) for _, c2, s2 in pts)}
    assert got == want


def test_t_distribution():
    for df, q in ((3, 3.1824), (10, 2.2281), (37, 2.0262), (200, 1.9719)):
        assert predict.t_quantile(0.975, df) == pytest.approx(q, abs=2e-4)
        assert predict.t_below(predict.t_quantile(0.2, df), df) == pytest.approx(0.2)


def test_predictions_and_calibration(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 3))
    y = 1400 + 30 * x[:, 0] - 10 * x[:, 1] + r.normal(size=400) * 4
    df = spark.createDataFrame([(k, *map(float, a), float(t) if k % 9 else None) for k, (a, t) in enumerate(zip(x, y, strict=True))], "k long, a double, b double, c double, y double")
    oof = predict.out_of_fold(df, "k", ["a", "b", "c"], "y")
    got = oof.toPandas()
    assert len(got) == df.where("y is not null").count()
    assert np.sqrt(((got["actual"] - got["predicted"]) ** 2).mean()) < 10
    c = predict.calibrated(oof)
    assert 3 <= c.df <= 200 and c.floor > 0
    s = c.sigma(F.col("neighbour_sd"))
    half = s * predict.t_quantile(0.975, c.df)
    inside = oof.select(F.avg((F.abs(F.col("actual") - F.col("predicted")) <= half).cast("int"))).first()[0]
    assert 0.9 < inside <= 1
    p = oof.select(c.above(F.col("predicted"), s, 1400.0).alias("p"), "predicted").where("(p > 0.5) != (predicted > 1400)")
    assert p.count() == 0


def test_components_equal_an_eigendecomposition(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 3)) @ r.normal(size=(3, 3))
    df = spark.createDataFrame([(k, *map(float, a)) for k, a in enumerate(x)] + [(999, None, 1.0, 2.0)], "k long, a double, b double, c double")
    scores, shares = explore.principal_components(df, "k", ["a", "b", "c"], 2)
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.eigvalsh(z.T @ z / 200)[::-1]
    assert np.allclose(shares, values / values.sum())
    got = scores.orderBy("k").toPandas()
    assert len(got) == 200 and np.allclose(got[["pc1", "pc2"]].var(ddof=0), values[:2])


def test_hulls_of_a_square_and_of_lines(spark):
    pts = [("s", float(a), float(b)) for a in range(4) for b in range(4)] + [("l", float(a), float(a)) for a in range(5)] + [("p", 1.0, 1.0)]
    got = explore.hulls(spark.createDataFrame(pts, "g string, x double, y double"), "g", "x", "y").orderBy("corner").collect()
    assert [(r["g"], r["x"], r["y"]) for r in got] == [("s", 0, 0), ("s", 3, 0), ("s", 3, 3), ("s", 0, 3)]


def test_components_from_products_equal_those_from_rows():
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 4)) @ r.normal(size=(4, 4))
    x = (x - x.mean(0)) / x.std(0)
    y = x @ np.array([1.0, -2, 0.5, 0]) + r.normal(size=300)
    turn = predict.components(x.T @ x / 300, x.T @ (y - y.mean()) / 300, 3)
    a, b = x.copy(), y - y.mean()
    for j in range(3):  # one component after the other, taken out of the rows
        t = a @ (a.T @ b)
        got = x @ turn[:, j]
        assert abs(np.corrcoef(t, got)[0, 1]) > 1 - 1e-9
        a, b = a - np.outer(t, t @ a) / (t @ t), b - t * (t @ b) / (t @ t)


def test_neighbours_equal_brute_force(spark):
    r = np.random.default_rng(6)
    x = r.integers(0, 4, (300, 5)).astype(float)  # many ties
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    got = explore.neighbours(df.where("k % 7 = 0"), df, "k", "v", 6, block=20).orderBy("query", "place").collect()
    for q in range(0, 300, 7):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [k for k in np.lexsort((np.arange(300), d)) if k != q][:6]
        assert [g["k"] for g in got if g["query"] == q] == want


def test_category_profiles_are_first_components(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(80, 4)) @ np.array([[1, 0.8, 0.2, 0], [0, 1, 0.5, 0], [0, 0, 1, 0], [0, 0, 0, 1.0]])
    x[::7, 1] = np.nan
    df = spark.createDataFrame([(k, *(None if np.isnan(v) else float(v) for v in row), 1.0) for k, row in enumerate(x)], "k long, a double, b double, c double, d double, e double")
    got = explore.category_profiles(df, "k", {"one": ["a", "b", "c"], "two": ["d"], "flat": ["e"]}).toPandas().set_index("k").sort_index()
    z = np.nan_to_num((x - np.nanmean(x, 0)) / np.nanstd(x, 0, ddof=1))
    w = np.linalg.eigh(np.cov(z[:, :3].T))[1][:, -1]
    p = (z[:, :3] - z[:, :3].mean(0)) @ w
    p = -p if np.corrcoef(p, z[:, :3].mean(1))[0, 1] < 0 else p
    assert np.allclose(got["one"], 100 * (p - p.min()) / (p.max() - p.min())) and np.allclose(got["two"], 100 * (x[:, 3] - x[:, 3].min()) / np.ptp(x[:, 3])) and (got["flat"] == 50).all()


def test_importances_of_the_chosen_models(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(200, 2))
    df = spark.createDataFrame([(k, float(a), float(b), float(3 * a + b + 0.1 * r.normal()), None) for k, (a, b) in enumerate(x)], "k long, a double, b double, y double, none double")
    got = {(c, p): (s, place) for c, p, s, _, place in impute.importances(df, ["a", "b", "y", "none"])}
    assert got["y", "a"][1] == 1 and got["y", "a"][0] == pytest.approx(0.75, abs=0.05) and got["y", "a"][0] + got["y", "b"][0] == pytest.approx(1)
    assert not any("none" in k for k in got)


def test_ranks_of_ties_and_nulls_within_groups(spark):
    from gristmill.operators.rank import average_ranks

    r = np.random.default_rng(10)
    rows = [(k, int(r.integers(3)), float(r.integers(6))) for k in range(300)]
    got = average_ranks(spark.createDataFrame(rows, "k long, g int, v double"), ["v"], ["g"]).toPandas().set_index("k")["rank_v"]
    for k, g, v in rows[:60]:
        own = [b for _, a, b in rows if a == g]
        assert got[k] == sum(b < v for b in own) + (sum(b == v for b in own) + 1) / 2
    assert average_ranks(spark.createDataFrame([(1, 1, None), (2, 1, 5.0)], "k long, g int, v double"), ["v"], ["g"]).count() == 2


def test_names_that_the_roster_lacks_are_told(spark):
    roster = spark.createDataFrame([(" a ", 1), ("b", 2), ("b ", 3), ("c", 4)], "judge string, v int")
    got = combine.by_name(roster, "judge", ["b", "a "]).orderBy("place", "v").collect()
    assert [(r["v"], r["place"]) for r in got] == [(2, 1), (3, 1), (1, 2)]
    assert combine.by_name(roster, "judge", []).count() == 0
    with pytest.raises(ValueError, match="x, y"):
        combine.by_name(roster, "judge", ["x", "a", "y"])
