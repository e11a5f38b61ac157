"""Latent models, walk-forward and exact neighbours against plain versions of the same rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import latent, walk
from gristmill.operators.metric import MetricIndex

COLUMNS = ["a_1", "a_2", "b_1", "b_2", "c"]


def matrix(seed, n=90, gaps=0.25):
    r = np.random.default_rng(seed)
    z = r.normal(size=(n, 2))
    x = z @ r.normal(size=(2, 5)) + 0.3 * r.normal(size=(n, 5))
    y = 10 + z @ [2.0, -1.0] + 0.2 * r.normal(size=n)
    x[r.random(x.shape) < gaps] = np.nan
    y[r.random(n) < 0.4] = np.nan
    return x, y


def frame(spark, x, y):
    number = lambda v: None if np.isnan(v) else float(v)
    rows = [(k, *map(number, row), number(t)) for k, (row, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in COLUMNS) + ", y double")


def scaled(y):
    return (y - np.nanmean(y)) / np.nanstd(y)


def plain_start(z, y, rank):
    fill = np.where(np.isnan(z), np.nanmedian(z, 0), z)
    _, s, v = np.linalg.svd(fill, full_matrices=False)
    v = v[:rank].T
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(rank)])
    places, has = fill @ v / np.sqrt(s[:rank]), ~np.isnan(y)
    w = np.linalg.solve((places[has] - places[has].mean(0)).T @ (places[has] - places[has].mean(0)) + 0.01 * np.eye(rank), (places[has] - places[has].mean(0)).T @ (y[has] - y[has].mean()))
    return v * np.sqrt(s[:rank]), w, y[has].mean() - places[has].mean(0) @ w


def plain_factors(x, y, rank, rounds, recall=1.0, supervise=5.0, shrink=0.01):
    z = (x - np.nanmean(x, 0)) / np.nanstd(x, 0)
    w, t, b = plain_start(z, y, rank)

    def places():
        out = np.zeros((len(z), rank))
        for i in range(len(z)):
            at = ~np.isnan(z[i])
            a, c = recall * w[at].T @ w[at] + shrink * np.eye(rank), recall * w[at].T @ z[i, at]
            if not np.isnan(y[i]):
                a, c = a + supervise * np.outer(t, t), c + supervise * (y[i] - b) * t
            out[i] = np.linalg.solve(a, c)
        return out

    losses, has = [], ~np.isnan(y)
    for n in range(rounds):
        p = places()
        losses.append(recall * np.nansum((z - p @ w.T) ** 2) + supervise * ((y - p @ t - b)[has] ** 2).sum() + shrink * ((p**2).sum() + (w**2).sum() + (t**2).sum()))
        if n == rounds - 1:
            break
        for j in range(z.shape[1]):
            at = ~np.isnan(z[:, j])
            w[j] = np.linalg.solve(recall * p[at].T @ p[at] + shrink * np.eye(rank), recall * p[at].T @ z[at, j])
        q = p[has] - p[has].mean(0)
        t = np.linalg.solve(q.T @ q + shrink / supervise * np.eye(rank), q.T @ (y[has] - y[has].mean()))
        b = y[has].mean() - p[has].mean(0) @ t
    return losses, w, t, b


def test_factors_are_those_of_plain_alternating_least_squares(spark):
    x, y = matrix(1)
    m = latent.Matrix.of(frame(spark, x, y), "k", COLUMNS, "y")
    f = latent.Factors(rank=2, rounds=15, tolerance=0).fit(m)
    losses, w, t, b = plain_factors(x, scaled(y), 2, 15)
    assert np.allclose(f.losses, losses, rtol=1e-8)
    assert all(b <= a + 1e-9 for a, b in zip(f.losses, f.losses[1:], strict=False)) and f.losses[-1] < f.losses[0]
    last = latent.Factors(rank=2)
    last.w, last.t, last.b = f.w, f.t, f.b
    got = {r["k"]: r["predicted"] for r in f.predict(m).collect()}
    assert len(got) == len(x) and np.corrcoef([got[k] for k in got if not np.isnan(y[k])], [y[k] for k in got if not np.isnan(y[k])])[0, 1] > 0.95
    hidden = np.isnan(y)
    assert hidden.sum() > 20 and np.isfinite([got[k] for k in np.flatnonzero(hidden)]).all()


def plain_evidence(z, y):
    """Bayesian ridge on centred rows."""
    zc, yc, n = z - z.mean(0), y - y.mean(), len(y)
    alpha, lam, w = 1 / (y.var() + 1e-12), 1.0, np.zeros(z.shape[1])
    for _ in range(300):
        before = w
        w = np.linalg.solve(zc.T @ zc + lam / alpha * np.eye(z.shape[1]), zc.T @ yc)
        e = np.linalg.eigvalsh(zc.T @ zc)
        g = (alpha * e / (lam + alpha * e)).sum()
        lam, alpha = (g + 2e-6) / (w @ w + 2e-6), (n - g + 2e-6) / (((yc - zc @ w) ** 2).sum() + 2e-6)
        if np.abs(w - before).sum() < 1e-6:
            break
    w = np.linalg.solve(zc.T @ zc + lam / alpha * np.eye(z.shape[1]), zc.T @ yc)
    return w, y.mean() - z.mean(0) @ w


def plain_traits(x, y, rank, rounds, groups, strength=1.0):
    z = (x - np.nanmean(x, 0)) / np.nanstd(x, 0)
    load, t, b = plain_start(z, y, rank)
    noise, has = np.full(z.shape[1], 0.5), ~np.isnan(y)
    spread, told = y[has].var(), []
    for _ in range(rounds):
        mean, cov = np.zeros((len(z), rank)), np.zeros((len(z), rank, rank))
        for i in range(len(z)):
            at = ~np.isnan(z[i])
            prec, pull = np.eye(rank) + load[at].T @ (load[at] / noise[at, None]), load[at].T @ (z[i, at] / noise[at])
            if has[i]:
                prec, pull = prec + np.outer(t, t) / spread, pull + t * (y[i] - b) / spread
            cov[i] = np.linalg.inv(prec)
            mean[i] = cov[i] @ pull
        middle = {j: load[g].mean(0) for g in groups for j in g}
        new, ll = load.copy(), 0.0
        for j in range(z.shape[1]):
            at = ~np.isnan(z[:, j])
            a = sum(cov[i] + np.outer(mean[i], mean[i]) for i in np.flatnonzero(at))
            new[j] = np.linalg.solve(a + strength * np.eye(rank), mean[at].T @ z[at, j] + strength * middle[j])
        load = new
        for j in range(z.shape[1]):
            at = np.flatnonzero(~np.isnan(z[:, j]))
            left = sum((z[i, j] - load[j] @ mean[i]) ** 2 + load[j] @ cov[i] @ load[j] for i in at)
            noise[j] = max(left / len(at), 1e-4)
            ll -= 0.5 * (len(at) * np.log(noise[j]) + left / noise[j])
        t, b = plain_evidence(mean[has], y[has])
        off = ((y - mean @ t - b)[has] ** 2).sum() + sum(t @ cov[i] @ t for i in np.flatnonzero(has))
        spread = max(off / has.sum(), 1e-4)
        told.append(ll - 0.5 * (has.sum() * np.log(spread) + off / spread))
    return load, noise, t, b, spread, told


def test_traits_are_those_of_plain_expectation_and_maximisation(spark):
    x, y = matrix(2)
    m = latent.Matrix.of(frame(spark, x, y), "k", COLUMNS, "y")
    groups = latent.prefix_families(COLUMNS)
    assert groups == [[0, 1], [2, 3], [4]]
    f = latent.Traits(rank=2, rounds=8, tolerance=0).fit(m, groups)
    load, noise, t, b, spread, told = plain_traits(x, scaled(y), 2, 8, groups)
    for own, want in ((f.loadings, load), (f.noise, noise), (f.t, t), (f.b, b), (f.spread, spread), (f.likelihoods, told)):
        assert np.allclose(own, want, rtol=1e-6, atol=1e-6)
    rows = f.predict(m).toPandas().set_index("k")
    hidden = np.isnan(y)
    assert (rows["sigma"] > 0).all() and rows["trait_sigmas"].map(min).min() > 0
    missing = np.isnan(x).sum(1)[rows.index]
    assert np.corrcoef(missing, rows["trait_sigmas"].map(np.mean))[0, 1] > 0.5
    assert rows["sigma"][hidden[rows.index]].mean() >= rows["sigma"][~hidden[rows.index]].mean()


def test_families_draw_loadings_together(spark):
    x, y = matrix(3, 60)
    m = latent.Matrix.of(frame(spark, x, y), "k", COLUMNS, "y")
    apart = lambda f: np.linalg.norm(f.loadings[0] - f.loadings[1])
    loose, tight = (latent.Traits(rank=2, rounds=6, strength=s).fit(m, [[0, 1], [2, 3, 4]]) for s in (1e-6, 300.0))
    assert apart(tight) < 0.5 * apart(loose)


def test_abilities_and_items_are_found_again(spark):
    r = np.random.default_rng(4)
    n, p = 400, 12
    ability, a, b = r.normal(size=n), r.uniform(0.6, 2.0, p), r.normal(size=p)
    x = 1 / (1 + np.exp(-(ability[:, None] * a - b))) + 0.02 * r.normal(size=(n, p))
    x[r.random(x.shape) < 0.2] = np.nan
    rows = spark.createDataFrame([(k, [float(v) for v in row], float("nan")) for k, row in enumerate(x)], "k long, x array<double>, y double").cache()
    f = latent.ItemResponse(rank=1, shrink=0.001, rounds=40).fit(rows, p)
    assert all(d <= c for c, d in zip(f.losses, f.losses[1:], strict=False))
    assert np.corrcoef(f.a[:, 0], a)[0, 1] > 0.97 and np.corrcoef(f.b, b)[0, 1] > 0.99
    got = latent.ability_features(rows, "k", f).toPandas().set_index("k").loc[range(n), "features"]
    own = np.stack(got.to_list())
    assert np.corrcoef(own[:, 0], ability)[0, 1] > 0.99 and np.allclose(own.mean(0), 0, atol=1e-9) and np.allclose(own.std(0), 1)


def test_matrices_without_rows_labels_or_values(spark):
    x, y = matrix(5, 30)
    x[:, 3] = np.nan
    for own in (frame(spark, x, np.full(30, np.nan)), frame(spark, x, y).limit(0)):
        m = latent.Matrix.of(own, "k", COLUMNS, "y")
        assert latent.Factors(rank=2, rounds=3).fit(m).predict(m).count() == own.count()
        assert latent.Traits(rank=2, rounds=3).fit(m).predict(m).count() == own.count()
        rows = latent.unit_range(own, "k", COLUMNS)
        f = latent.ItemResponse(rounds=3).fit(rows, 5)
        assert latent.ability_features(rows, "k", f).count() == own.count()


@pytest.mark.parametrize("parts", [0, 2])
def test_each_step_is_a_refit_on_what_came_before(spark, monkeypatch, parts):
    monkeypatch.setattr(walk, "STEPS", 7)
    r = np.random.default_rng(6)
    n = 300
    t, x = r.integers(0, 60, n), r.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 10, -3]
    y = x @ [1.0, 0.5, -4.0] + r.normal(size=n) + t / 20
    rows = [(k, int(t[k]), *map(float, x[k]), float(y[k])) for k in range(n)] + [(900, 3, None, 1.0, 1.0, 2.0), (901, None, 1.0, 1.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k long, t long, a double, b double, c double, y double")
    got = {v["k"]: v for v in walk.walk_forward(df, "k", F.col("t"), ["a", "b", "c"], "y", 0.5, 2.0, parts).collect()}
    want = {}
    for k in range(n):
        past = t < t[k]
        if past.sum() < n // 2:
            continue
        m, s = x[past].mean(0), x[past].std(0)
        z, yc = (x[past] - m) / s, y[past] - y[past].mean()
        if parts:  # least squares on the span of the cross product and its image
            c = z.T @ yc / len(z)
            turn = np.c_[c, z.T @ z @ c / len(z)]
            beta = turn @ np.linalg.lstsq(z @ turn, yc, rcond=None)[0]
        else:
            beta = np.linalg.solve(z.T @ z + 2.0 * np.eye(3), z.T @ yc)
        want[k] = (y[past].mean() + (x[k] - m) / s @ beta, past.sum())
    assert set(got) == set(want) and 100 < len(want) < 200
    assert all(got[k]["predicted"] == pytest.approx(p, rel=1e-7, abs=1e-7) and got[k]["n_train"] == c for k, (p, c) in want.items())
    errors = walk.walk_errors(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "actual double, predicted double")).first()
    assert errors["n"] == 3 and errors["rmse"] == pytest.approx((2 / 3) ** 0.5) and errors["r2"] == pytest.approx(0.75)
    assert walk.walk_forward(df.limit(0), "k", F.col("t"), ["a", "b"], "y").count() == 0


@pytest.mark.parametrize("pivots,block", [(1, 4096), (12, 8), (40, 5)])
def test_neighbours_are_those_of_all_pairs(spark, monkeypatch, pivots, block):
    from gristmill.operators import metric

    monkeypatch.setattr(metric, "ROWS", block)
    monkeypatch.setattr(metric, "QUERIES", block)
    r = np.random.default_rng(pivots)
    x = np.concatenate([r.normal(size=(60, 4)) * 0.2 + 10 * r.normal(size=4) for _ in range(6)])
    x[5], x[6], x[7] = x[4], x[4], x[4]  # ties
    ids = list(range(0, 360, 6)) + [4, 5, 6, 7]
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, v array<double>")
    found, told = MetricIndex(df, "id", "v", pivots).nearest(df.where(F.col("id").isin(ids)), "id", "v", 3)
    got = {}
    for q in found.orderBy("query", "place").collect():
        got.setdefault(q["query"], []).append((q["id"], q["distance"]))
    for q in set(ids):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        near = [j for j in np.lexsort((np.arange(len(x)), d)) if j != q][:3]
        assert [j for j, _ in got[q]] == near and np.allclose([e for _, e in got[q]], d[near])
    visited = {v["query"]: v["visited"] for v in told.collect()}
    assert set(visited) == set(ids) and max(visited.values()) <= pivots
    assert pivots == 1 or np.mean(list(visited.values())) < 0.6 * pivots


def test_neighbours_of_few_or_no_rows(spark):
    df = spark.createDataFrame([("a", [0.0]), ("b", [1.0])], "id string, v array<float>")
    got = MetricIndex(df, "id", "v").nearest(df, "id", "v", 5)[0].collect()
    assert sorted((r["query"], r["id"], r["place"]) for r in got) == [("a", "b", 1), ("b", "a", 1)]
    assert MetricIndex(df.limit(0), "id", "v").nearest(df, "id", "v", 5)[0].count() == 0
    assert MetricIndex(df, "id", "v").nearest(df.limit(0), "id", "v", 5)[0].count() == 0


@pytest.mark.parametrize("inductive", [False, True])
def test_rows_are_told_by_models_that_have_not_seen_them(spark, inductive):
    x, y = matrix(7, 60)
    df = frame(spark, x, y)
    got = latent.cross_validated(df, "k", COLUMNS, "y", lambda: latent.Factors(rank=2, rounds=8, tolerance=0), 3, inductive).toPandas().set_index("k").sort_index()
    assert list(got.index) == list(np.flatnonzero(~np.isnan(y))) and np.allclose(got["actual"], y[~np.isnan(y)])
    fold = np.array([r[0] for r in df.orderBy("k").select(F.pmod(F.xxhash64("k"), F.lit(3))).collect()])
    for f in range(3):
        rest = fold != f
        learn, target = (x[rest], y[rest]) if inductive else (x, np.where(rest, y, np.nan))
        losses, w, t, b = plain_factors(learn, scaled(target), 2, 8)
        z = (x - np.nanmean(learn, 0)) / np.nanstd(learn, 0)
        for k in got.index[fold[got.index] == f]:
            at = ~np.isnan(z[k])
            place = np.linalg.solve(w[at].T @ w[at] + 0.01 * np.eye(2), w[at].T @ z[k, at])
            assert got.loc[k, "predicted"] == pytest.approx(np.nanmean(target) + np.nanstd(target) * (place @ t + b), rel=1e-6)
