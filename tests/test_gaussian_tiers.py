"""Gaussian processes against the dense solution, tiers against a plain version."""

import numpy as np
import pandas as pd
import pytest

from gristmill.operators import coherence, gaussian, impute, reach, tiers
from gristmill.operators.impute import Linear


def table(seed, n):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    return x, np.sin(1.5 * x[:, 0]) + 0.4 * x[:, 1] + 0.1 * r.normal(size=n) + 5


def frame(spark, x, y):
    return spark.createDataFrame([(k, *map(float, a), None if np.isnan(b) else float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "k long, a double, b double, y double")


def test_all_rows_as_points_give_the_dense_solution(spark):
    x, y = table(1, 50)
    y[44:] = np.nan
    df = frame(spark, x, y)
    g = gaussian.GaussianProcess(points=100, noises=[0.03, 0.1, 0.3]).fit(df, "k", ["a", "b"], "y")
    z, t = (x - x[:44].mean(0)) / x[:44].std(0), (y[:44] - y[:44].mean()) / y[:44].std()
    told = []
    for scale in sorted({*g.scales, g.scale}):
        for linear in g.linear:
            k = gaussian.kernel(z[:44], z[:44], scale, linear)
            for noise in g.noises:
                c = k + noise * np.eye(44)
                s = t @ np.linalg.solve(c, t) / 44
                told.append((-0.5 * (44 * np.log(2 * np.pi * s) + 44 + np.linalg.slogdet(c)[1]), scale, linear, noise, s))
    best = max(told)
    assert (g.scale, g.slope, g.noise) == best[1:4] and g.likelihood == pytest.approx(best[0], abs=1e-3) and g.amplitude == pytest.approx(best[4], rel=1e-4)
    c = gaussian.kernel(z[:44], z[:44], *best[1:3]) + best[3] * np.eye(44)
    cross = gaussian.kernel(z, z[:44], *best[1:3])
    mean = y[:44].mean() + y[:44].std() * cross @ np.linalg.solve(c, t)
    own = gaussian.kernel(z, z, *best[1:3]).diagonal()
    var = y[:44].var() * best[4] * (own - np.einsum("ij,ji->i", cross, np.linalg.solve(c, cross.T)) + best[3])
    got = g.predict(df).toPandas().set_index("k").sort_index()
    assert np.allclose(got["value"], mean, atol=1e-4) and np.allclose(got["sigma2"], var, rtol=1e-3, atol=1e-5)


def test_few_points_tell_many_rows(spark):
    x, y = table(2, 1500)
    x[::9, 1] = np.nan
    y[1200:] = np.nan
    df = spark.createDataFrame([(k, float(a[0]), None if np.isnan(a[1]) else float(a[1]), None if np.isnan(b) else float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "k long, a double, b double, y double")
    g = gaussian.GaussianProcess(points=40).fit(df, "k", ["a", "b"], "y")
    got = g.predict(df).toPandas().set_index("k").sort_index()
    _, clean = table(2, 1500)
    whole = ~np.isnan(x[1200:, 1])
    e = (got["value"].to_numpy()[1200:] - clean[1200:])[whole]
    assert e.std() < 0.35 * clean.std() and (np.abs(e) < 2.5 * np.sqrt(got["sigma2"].to_numpy()[1200:][whole])).mean() > 0.9
    few = gaussian.GaussianProcess().fit(df.limit(2), "k", ["a", "b"], "y").predict(df)
    assert few.count() == 1500 and few.where("value is null").count() == 0


def plain_tiers(x, columns, opts):
    """The same rules row by row; models by the library's ridge on complete rows."""
    own = pd.DataFrame(x, columns=columns)
    seen = own.notna()
    gaps = {c: 1 - seen[c].mean() for c in columns if 0 < seen[c].sum() < len(own)}
    r = own.corr().abs()
    n = seen.astype(int).T @ seen.astype(int)
    strongest = {c: r[c].drop(c).max() for c in columns}
    difficulty = {c: gaps[c] * (1 - strongest[c]) for c in gaps}
    cuts = [np.quantile(list(difficulty.values()), q) for q in opts.shares]
    tier = {c: sum(v > cut for cut in cuts) for c, v in difficulty.items()}
    models, tol = {}, {}
    for c in gaps:
        near = sorted((o for o in columns if o != c and n.loc[c, o] >= 10), key=lambda o: (-r.loc[c, o] * np.sqrt(n.loc[c, o]), o))[: opts.proxies]
        p = sorted(near)
        whole = own[[*p, c]].dropna()
        one = np.c_[np.ones(len(whole)), whole.to_numpy()]
        models[c] = Linear(p, one.T @ one)

    def tell(c, row):
        m = models[c]
        z = np.array([(row[q] - a) / s for q, a, s in zip(m.predictors, m.mean, m.sd, strict=True)])
        out = np.isnan(z)
        z = np.nan_to_num(z)
        return m.level + z @ m.beta, np.sqrt(m.sigma2 * (1 + 1 / m.n + z @ m.inverse @ z) + (m.beta[out] ** 2).sum())

    for c, m in models.items():
        whole = own[own[[*m.predictors, c]].notna().all(axis=1)]
        tol[c] = np.quantile([tell(c, row)[1] for _, row in whole.iterrows()], opts.percentile) * opts.multiplier
    rounds, sigma, now, log = seen.astype(float).where(seen, np.nan) * 0, seen.astype(float).where(seen, np.nan) * 0, own.copy(), []
    for k in range(1, opts.rounds + 1):
        wrote = 0
        for t in sorted(set(tier.values())):
            before = now.copy()
            for c in [c for c in columns if tier.get(c) == t]:
                cells = [(i, *tell(c, before.loc[i])) for i in before.index[before[c].isna()]]
                if not cells:
                    continue
                sure = [v for v in cells if v[2] <= tol[c]]
                if not sure:
                    sure = [min(cells, key=lambda v: (v[2], v[0]))]
                    tol[c] *= opts.relax
                for i, v, s in sure:
                    now.loc[i, c], sigma.loc[i, c], rounds.loc[i, c] = v, s, k
                log.append((k, t, c, len(sure)))
                wrote += len(sure)
        if not wrote:
            break
    return now, sigma, rounds, log


@pytest.mark.parametrize("multiplier,rounds", [(1.2, 14), (0.6, 6)])
def test_tiers_fill_the_cells_that_plain_rounds_fill(spark, multiplier, rounds):
    r = np.random.default_rng(5)
    z = r.normal(size=(80, 2))
    columns = ["a", "b", "c", "d", "e"]
    x = z @ r.normal(size=(2, 5)) + 0.3 * r.normal(size=(80, 5)) + 7
    for j, share in enumerate((0, 0.1, 0.25, 0.4, 0.3)):
        x[r.random(80) < share, j] = np.nan
    df = spark.createDataFrame([(k, *(None if np.isnan(v) else float(v) for v in row)) for k, row in enumerate(x)], "k long, " + ", ".join(f"{c} double" for c in columns))
    own = tiers.Tiers(multiplier=multiplier, rounds=rounds)
    got = own.filled(df, "k", columns).toPandas()
    now, sigma, told, log = plain_tiers(x, columns, tiers.Tiers(multiplier=multiplier, rounds=rounds))
    assert own.log == log and len({v[0] for v in log}) > 1
    for c in columns:
        mine = got[got["column"] == c].set_index("k").sort_index()
        assert np.array_equal(np.isnan(mine["round"].astype(float)), told[c].isna()) and np.allclose(mine["round"].astype(float).dropna(), told[c].dropna())
        filled = told[c].notna()
        assert np.allclose(mine["value"][filled], now[c][filled]) and np.allclose(mine["sigma"][filled], sigma[c][filled])
        assert np.allclose(mine["value"][~filled], np.nanmedian(x[:, columns.index(c)])) if (~filled).any() else True


def test_tiers_of_odd_tables(spark):
    df = spark.createDataFrame([(k, float(k), None, float(k) if k % 3 else None) for k in range(30)], "k long, a double, b double, c double")
    got = tiers.Tiers().filled(df, "k", ["a", "b", "c"]).toPandas()
    assert len(got) == 90 and got[got["column"] == "b"]["value"].isna().all() and np.allclose(got[got["column"] == "c"].sort_values("k")["value"], range(30), atol=0.5)
    assert tiers.Tiers().filled(df.limit(0), "k", ["a", "b"]).count() == 0


def cells_of(spark, seed, n=70):
    r = np.random.default_rng(seed)
    z = r.normal(size=(n, 2))
    x = z @ r.normal(size=(2, 4)) + 0.3 * r.normal(size=(n, 4)) + 3
    x[r.random(x.shape) < 0.25] = np.nan
    x[:, 0] = z[:, 0]
    df = spark.createDataFrame([(k, *(None if np.isnan(v) else float(v) for v in row)) for k, row in enumerate(x)], "k long, a double, b double, c double, d double")
    return x, impute.filled(df, "k", list("abcd")).cache()


@pytest.mark.parametrize("shape,gate", [("linear", "fixed"), ("squared", "fixed"), ("power3", "fixed"), ("exp", "fixed"), ("step", "fixed"), ("linear", "row_adaptive"), ("linear", "learned")])
def test_cells_are_drawn_as_plain_matrices_are(spark, shape, gate):
    x, cells = cells_of(spark, 3)
    own = cells.toPandas()
    v, s2 = (own.pivot(index="k", columns="column", values=c).to_numpy(float) for c in ("value", "sigma2"))
    there, strength = ~np.isnan(x), 0.05
    sd, mean = np.array([x[there[:, j], j].std(ddof=1) for j in range(4)]), v.mean(0)
    z = (v - mean) / sd
    left, sing, right = np.linalg.svd(z, full_matrices=False)
    smooth = left[:, :2] * sing[:2] @ right[:2] * sd + mean
    rest = np.array([((v - smooth)[there[:, j], j] ** 2).mean() for j in range(4)])
    t, row = s2 / sd**2, there.mean(1)[:, None]
    w = {"linear": t / (t + strength), "squared": t**2 / (t**2 + strength), "power3": t**3 / (t**3 + strength), "exp": 1 - np.exp(-t / strength), "step": (t > strength) * 1.0}[shape]
    if gate == "row_adaptive":
        w = t / (t + strength * row**2)
    if gate == "learned":
        f, aim = [], []
        feats = lambda i, j, tau: [tau, row[i, 0], there[:, j].mean(), rest[j] / sd[j] ** 2, abs(v[i, j] - smooth[i, j]) / sd[j]]
        for j in (1, 2, 3):
            usual = s2[~there[:, j], j].mean()
            for i in np.flatnonzero(there[:, j]):
                f.append(feats(i, j, usual / sd[j] ** 2))
                aim.append(usual / (usual + (v[i, j] - smooth[i, j]) ** 2 + 1e-10))
        f, aim = np.array(f), np.array(aim)
        c = f - f.mean(0)
        beta = np.linalg.solve(c.T @ c + np.eye(5), c.T @ (aim - aim.mean()))
        level = aim.mean() - f.mean(0) @ beta
        w = np.array([[np.clip(level + np.array(feats(i, j, t[i, j])) @ beta, 0, 1) for j in range(4)] for i in range(len(v))])
    w = np.where(there, 0, w)
    got = coherence.drawn(cells, "k", list("abcd"), 2, strength, shape, gate).toPandas()
    mine = {c: got.pivot(index="k", columns="column", values=c).to_numpy(float) for c in ("value", "sigma2", "weight")}
    assert np.allclose(mine["weight"], w, atol=1e-7) and np.allclose(mine["value"], (1 - w) * v + w * smooth) and np.allclose(mine["sigma2"], (1 - w) ** 2 * s2 + w**2 * rest)
    with pytest.raises(ValueError):
        coherence.drawn(cells, "k", list("abcd"), 2, shape="round")


def test_rows_far_from_all_have_great_ratios(spark):
    r = np.random.default_rng(4)
    x = np.r_[r.normal(size=(80, 2)), [[30.0, 30.0]]]
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "k long, a double, b double")
    got = reach.distance_ratios(df.where("k < 80"), df, "k", ["a", "b"]).toPandas().set_index("k")["ratio"]
    assert len(got) == 81 and got[80] > 5 * got[:80].max() and got[:80].median() < 1
    assert (reach.distance_ratios(df.limit(0), df, "k", ["a", "b"]).toPandas()["ratio"] == 0).all()
    same = spark.createDataFrame([(k, 1.0, 1.0) for k in range(9)], "k long, a double, b double")
    assert (reach.distance_ratios(same, same, "k", ["a", "b"]).toPandas()["ratio"] == 0).all()


def test_copies_of_rows_do_not_multiply_the_search(spark, monkeypatch):
    """Each place is asked once, k + 1 rows of a place are searched, and ratios are those of all rows."""
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 2)).round(2)
    x = np.r_[x, x[:30], *[x[:10]] * 20]
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(x)]
    seen, asked = spark.createDataFrame(rows, "k long, a double, b double"), spark.createDataFrame([*rows[:-40], (998, 0.5, 0.25), (rows[-1][0], 0.1, 0.1)], "k long, a double, b double")
    met = []
    init, nearest = reach.MetricIndex.__init__, reach.MetricIndex.nearest
    monkeypatch.setattr(reach.MetricIndex, "__init__", lambda self, df, *a, **o: (met.append(df.count()), init(self, df, *a, **o))[1])
    monkeypatch.setattr(reach.MetricIndex, "nearest", lambda self, df, *a, **o: (met.append(df.count()), nearest(self, df, *a, **o))[1])
    got = reach.distance_ratios(seen, asked, "k", ["a", "b"]).toPandas().set_index("k")["ratio"]
    assert met == [10 * 6 + 20 * 2 + 30, 62]
    z = (x - x.mean(0)) / x.std(0)
    own = {k: (np.array([a, b]) - x.mean(0)) / x.std(0) for k, a, b in [(r["k"], r["a"], r["b"]) for r in asked.collect()]}
    want = {k: np.sort(np.sqrt(((np.delete(z, k, 0) if k < len(z) else z) - v) ** 2 @ [1, 1]))[4] for k, v in own.items()}
    scale = want[998] / got[998]
    assert all(np.isclose(got[k] * scale, want[k]) for k in own) and len(got) == len(own)
