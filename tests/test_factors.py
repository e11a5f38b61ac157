"""Factors, families, chains and held-out fits against NumPy."""

import numpy as np
from pyspark.sql import functions as F

from gristmill.operators import factors, predict


def frame(spark, x, names):
    rows = [(k, *[None if np.isnan(v) else float(v) for v in row]) for k, row in enumerate(x)]
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} double" for n in names))


def test_factor_models_give_the_correlations_back():
    r = np.random.default_rng(0)
    load = np.array([[0.9, 0], [0.8, 0.1], [0.7, 0], [0, 0.8], [0.1, 0.7], [0, 0.6]])
    corr = load @ load.T
    np.fill_diagonal(corr, 1)
    got, own = factors.factor_loadings(corr, 2)
    assert np.allclose(got @ got.T + np.diag(own), corr, atol=1e-3)
    order = np.argsort(-np.abs(got[0]))
    assert np.allclose(got[:, order], load, atol=0.1) and (got.mean(0) > 0).all()
    one, _ = factors.factor_loadings(np.array([[1, 0.56, 0.48], [0.56, 1, 0.42], [0.48, 0.42, 1]]), 1)
    assert np.allclose(one[:, 0], [0.8, 0.7, 0.6], atol=1e-3)
    assert r is not None


def spread(points):
    return ((points - points.mean(0)) ** 2).sum()


def test_ward_joins_what_grows_least():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(c, 0.4, (6, 2)) for c in ((0, 0), (4, 0), (0, 5))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    groups = [[k] for k in range(len(x))]
    while len(groups) > 3:
        i, j = min(((a, b) for a in range(len(groups)) for b in range(a + 1, len(groups))), key=lambda p: spread(x[groups[p[0]] + groups[p[1]]]) - spread(x[groups[p[0]]]) - spread(x[groups[p[1]]]))
        groups[i] += groups.pop(j)
    want = [next(g for g, own in enumerate(groups) if k in own) for k in range(len(x))]
    for linkage in ("ward", "average"):
        got = factors.agglomerated(d, 3, linkage)
        assert [got[k] == got[m] for k in range(18) for m in range(k)] == [want[k] == want[m] for k in range(18) for m in range(k)]


def test_held_out_fits_scores_families_and_smoothing(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 4))
    x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
    y = x @ np.array([1.0, 0.5, -2, 0]) + r.normal(size=200)
    df = frame(spark, np.column_stack([x, y]), "abcdy").cache()
    fold = F.col("k") % 5
    g = factors.fold_products(df, list("abcd"), "y", fold, 5)
    for use, alpha in (((0, 2), 0.0), ((0, 1, 2, 3), 10.0)):
        e = []
        for f in range(5):
            test = np.arange(200) % 5 == f
            m, s = x[~test][:, use].mean(0), x[~test][:, use].std(0)
            z, t = (x[:, use] - m) / s, y[~test].mean()
            beta = np.linalg.solve(z[~test].T @ z[~test] + alpha * np.eye(len(use)), z[~test].T @ (y[~test] - t))
            e.append(((y[test] - t - z[test] @ beta) ** 2).sum())
        assert abs(factors.held_out(g, use, alpha)[0] - np.sqrt(sum(e) / 200)) < 1e-6
    alpha, error, r2 = factors.ridge_cv(df, list("abcd"), "y", fold, 5, [0.0, 1.0, 1000.0])
    assert alpha < 1000 and error == factors.held_out(g, range(4), alpha)[0] and r2 > 0.6
    steps = factors.incremental_r2(df, [["a", "b"], ["c"], ["d"]], "y", fold, 5)
    assert steps[1] > steps[0] + 0.3 and abs(steps[2] - steps[1]) < 0.05
    assert factors.families(df, list("abcd"), 3) == {"a": 0, "b": 0, "c": 1, "d": 2}
    s = factors.factor_scores(df, "k", list("abcd"), 1).orderBy("k").toPandas()
    assert len(s) == 200 and abs(np.corrcoef(s["f1"], x[:, 0])[0, 1]) > 0.9
    curve = frame(spark, np.column_stack([np.linspace(0, 3, 400), np.linspace(0, 3, 400) ** 2]), "xy")
    assert all(abs(b - a * a) < 0.15 for a, b in factors.smoothed(curve, "x", "y", 0.2, 40))
    assert factors.in_original_units([2.0], 1.0, [3.0], [4.0]) == ([0.5], -0.5)


def test_chained_regressions_equal_a_plain_iteration(spark):
    r = np.random.default_rng(3)
    full = r.normal(size=(80, 2)) @ r.normal(size=(2, 4)) + 0.05 * r.normal(size=(80, 4))
    x = np.where(r.random(full.shape) < 0.15, np.nan, full)
    got = np.array([tuple(t)[1:] for t in factors.chained(frame(spark, x, "abcd"), "k", list("abcd"), 4).orderBy("k").collect()])
    now = np.where(np.isnan(x), np.nanmedian(x, 0), x)
    for _ in range(4):
        m, g, fit = now.mean(0), np.cov(now.T, ddof=0), now.copy()
        for i in range(4):
            rest = [j for j in range(4) if j != i]
            a = g[np.ix_(rest, rest)]
            fit[:, i] = m[i] + (now[:, rest] - m[rest]) @ np.linalg.solve(a + 1e-3 * np.diag(np.diag(a)), g[rest, i])
        now = np.where(np.isnan(x), fit, x)
    assert np.allclose(got, now, atol=1e-6)


def test_intervals_levels_and_leaders(spark):
    low, high = predict.exact_interval(3, 10)
    assert abs(low - 0.06674) < 1e-4 and abs(high - 0.65245) < 1e-4
    assert predict.exact_interval(0, 5)[0] == 0 and predict.exact_interval(5, 5)[1] == 1
    z = np.random.default_rng(4).standard_t(8, 20_000) * 1.7
    assert abs(predict.level_scalar(z, np.ones_like(z), 8.0) - 1.7) < 0.05
    df = spark.createDataFrame([(1, 10.0, 9.0, 1.0), (2, None, 12.0, 1.0), (3, None, 8.0, 1.0)], "k int, y double, p double, s double")
    got = {r["k"]: r["p_leader"] for r in predict.beats_leader(df, predict.Calibration(0.5, 10.0, 1.0), "s", "y", "p").collect()}
    assert got[1] is None and got[2] > 0.95 and got[3] < 0.05
