"""Trees against exhaustive search and against plain boosting."""

import numpy as np
import pytest

from gristmill.operators import trees as T

COLUMNS = ["a", "b", "c"]


def data(seed, n=120, levels=12):
    r = np.random.default_rng(seed)
    x = r.integers(0, levels, (n, 3)).astype(float)
    y = np.where(x[:, 0] > 5, 10, 0) + x[:, 1] + 0.5 * r.normal(size=n)
    x[r.random(x.shape) < 0.1] = np.nan
    y[r.random(n) < 0.15] = np.nan
    return x, y


def frame(spark, x, y):
    number = lambda v: None if np.isnan(v) else float(v)
    return spark.createDataFrame([(k, *map(number, row), number(t)) for k, (row, t) in enumerate(zip(x, y, strict=True))], "k long, a double, b double, c double, y double")


def plain_tree(x, y, depth, least):
    """Exhaustive search over all values of all columns; missing values go left. A function of rows."""
    best = None
    if depth and len(y) >= 2 * least:
        for c in range(x.shape[1]):
            for v in [-np.inf, *np.unique(x[:, c][~np.isnan(x[:, c])])]:
                left = np.isnan(x[:, c]) | (x[:, c] <= v)
                if least <= left.sum() <= len(y) - least:
                    err = ((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum()
                    if best is None or err < best[0] - 1e-9:
                        best = (err, c, v, left)
    if best is None or best[0] >= ((y - y.mean()) ** 2).sum() * (1 - 1e-9):
        return lambda rows: np.full(len(rows), y.mean())
    _, c, v, left = best
    low, high = plain_tree(x[left], y[left], depth - 1, least), plain_tree(x[~left], y[~left], depth - 1, least)
    return lambda rows: np.where(np.isnan(rows[:, c]) | (rows[:, c] <= v), low(rows), high(rows))


def plain_boosted(x, y, rounds, depth, rate, least):
    steps, now = [], np.full(len(y), y.mean())
    for _ in range(rounds):
        steps.append(plain_tree(x, y - now, depth, least))
        now = now + rate * steps[-1](x)
    return lambda rows: y.mean() + rate * sum(s(rows) for s in steps)


def predictions(spark, own, models):
    rows = T.told(own, models).toPandas().set_index("k").sort_index()
    return np.stack(rows["whole"].to_list()), np.stack(rows["apart"].to_list()), rows["fold"].to_numpy(), rows["actual"].to_numpy(float)


@pytest.mark.parametrize("depth,least", [(1, 1), (3, 5), (4, 2)])
def test_a_tree_is_what_exhaustive_search_finds(spark, depth, least):
    x, y = data(depth)
    own = T.Binned.of(frame(spark, x, y), "k", COLUMNS, "y", folds=3)
    model = T.Boosted(depth=depth, least=least, rounds=1, rate=1.0).fit(own)
    whole, apart, fold, actual = predictions(spark, own, [model])
    known = ~np.isnan(y)
    assert np.array_equal(np.isnan(actual), ~known) and set(fold) == {0, 1, 2}
    assert np.allclose(whole[:, 0], plain_tree(x[known], y[known], depth, least)(x))
    for g in range(3):
        learn = known & (fold != g)
        assert np.allclose(apart[fold == g, 0], plain_tree(x[learn], y[learn], depth, least)(x)[fold == g])


def test_boosting_is_plain_boosting(spark):
    x, y = data(9)
    own = T.Binned.of(frame(spark, x, y), "k", COLUMNS, "y", folds=2)
    model = T.Boosted(depth=2, least=3, rounds=6, rate=0.3).fit(own)
    whole, apart, fold, _ = predictions(spark, own, [model])
    known = ~np.isnan(y)
    assert np.allclose(whole[:, 0], plain_boosted(x[known], y[known], 6, 2, 0.3, 3)(x))
    learn = known & (fold != 1)
    assert np.allclose(apart[fold == 1, 0], plain_boosted(x[learn], y[learn], 6, 2, 0.3, 3)(x)[fold == 1])
    assert ((y - whole[:, 0])[known] ** 2).mean() < 0.3 * y[known].var()


def test_forests_votes_and_stacks(spark):
    x, y = data(10, 400)
    own = T.Binned.of(frame(spark, x, y), "k", COLUMNS, "y", folds=4)
    bagged, random_, boosted = T.Forest(n_trees=8, depth=5).fit(own), T.Forest(n_trees=8, depth=5, random_cuts=True, share=0.7, seed=3).fit(own, together=7), T.Boosted(rounds=10, rate=0.3).fit(own)
    whole, apart, _, _ = predictions(spark, own, [bagged, random_, boosted])
    known, var = ~np.isnan(y), np.nanvar(y)
    assert (((y[:, None] - apart)[known] ** 2).mean(0) < 0.35 * var).all()
    assert (((y[:, None] - whole)[known] ** 2).mean(0) < ((y[:, None] - apart)[known] ** 2).mean(0)).all()
    assert [c for c, _ in T.top_columns(bagged, COLUMNS, 2)] == ["a", "b"] and bagged.importances().sum() == pytest.approx(1)
    assert random_.importances()[2] < 0.1
    votes = T.voted(own, [random_, boosted]).toPandas().set_index("k").sort_index()
    want = np.where(known, apart[:, 1:].mean(1), whole[:, 1:].mean(1))
    assert np.allclose(votes["predicted"], want)
    rows, w, b = T.stacked(own, [bagged, random_, boosted])
    design = np.c_[np.ones(known.sum()), apart[known]]
    c = design[:, 1:] - design[:, 1:].mean(0)
    beta = np.linalg.solve(c.T @ c + 1e-3 * np.eye(3), c.T @ (y[known] - y[known].mean()))
    assert np.allclose(w, beta) and b == pytest.approx(y[known].mean() - design[:, 1:].mean(0) @ beta)
    e = T.held_out_errors(rows, "1 + actual / 50").first()
    assert e["n"] == known.sum() and e["rmse"] <= min(T.held_out_errors(T.voted(own, [m])).first()["rmse"] for m in (bagged, random_, boosted)) + 1e-6


def test_lines_of_all_folds_come_from_one_pass(spark):
    x, y = data(11, 150)
    own = T.Binned.of(frame(spark, x, y), "k", COLUMNS, "y", folds=3)
    models = [("mean", T.Line().fit(own)), ("line", T.Line([0, 1], 2.0).fit(own))]
    whole, apart, fold, _ = predictions(spark, own, [m for _, m in models])
    known = ~np.isnan(y)
    m, s = np.nanmean(x[known][:, :2], 0), np.nanstd(x[known][:, :2], 0)
    z = np.nan_to_num((x[:, :2] - m) / s)
    for g in [0, 1, 2, None]:
        learn = known & (fold != g) if g is not None else known
        c = z[learn] - z[learn].mean(0)
        w = np.linalg.solve(c.T @ c + 2 * np.eye(2), c.T @ y[learn])
        want, at = y[learn].mean() + (z - z[learn].mean(0)) @ w, fold == g if g is not None else fold >= 0
        got = apart if g is not None else whole
        assert np.allclose(got[at, 1], want[at]) and np.allclose(got[at, 0], y[learn].mean())
    rows = {r["candidate"]: r for r in T.candidates(own, models, "1 + actual / 50").collect()}
    e, w = (y[:, None] - apart)[known], 1 + y[known] / 50
    assert rows["line"]["weighted_rmse"] == pytest.approx(np.sqrt((w * e[:, 1] ** 2).sum() / w.sum())) and rows["line"]["chosen"] and not rows["mean"]["chosen"]
    assert rows["mean"]["rmse"] == pytest.approx(np.sqrt((e[:, 0] ** 2).mean())) and rows["mean"]["n"] == known.sum()


def test_samples_are_drawn_with_replacement():
    n = T.draws(np.arange(20000), 5)
    assert abs(n.mean() - 1) < 0.03 and abs((n == 0).mean() - np.exp(-1)) < 0.02 and not np.array_equal(n, T.draws(np.arange(20000), 6))


def test_many_values_are_cut_at_percentiles(spark):
    r = np.random.default_rng(1)
    x = np.c_[r.normal(size=(500, 2)), np.ones(500)]
    own = T.Binned.of(frame(spark, x, x[:, 0] * 2), "k", COLUMNS, "y", folds=1, bins=8)
    assert [len(e) for e in own.edges] == [7, 7, 0]
    bins = np.array(own.rows.orderBy("k").toPandas()["x"].to_list())
    assert (np.bincount(bins[:, 0])[1:] == pytest.approx(62.5, abs=1)) and set(bins[:, 2]) == {1}
    model = T.Forest(n_trees=3, depth=3).fit(own)
    assert np.isfinite(predictions(spark, own, [model])[0]).all()


def test_tables_without_rows_or_targets(spark):
    x, y = data(2, 20)
    for df in (frame(spark, x, y).limit(0), frame(spark, x, np.full(20, np.nan))):
        own = T.Binned.of(df, "k", COLUMNS, "y", folds=2)
        models = [T.Forest(n_trees=2, depth=2).fit(own), T.Boosted(rounds=2).fit(own)]
        assert T.voted(own, models).count() == df.count() and T.stacked(own, models)[0].count() == df.count()
        assert T.top_columns(models[0], COLUMNS, 2) == [("a", 0.0), ("b", 0.0)]
