"""The model bank against NumPy on small matrices."""

import numpy as np
import pytest

from gristmill.operators import bank


def frame(spark, x, names):
    rows = [(k, *[None if np.isnan(v) else float(v) for v in row]) for k, row in enumerate(x)]
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} double" for n in names))


@pytest.fixture(scope="module")
def matrix():
    r = np.random.default_rng(4)
    a, b, c = r.normal(size=(3, 160))
    d = 2 * a - b + 0.1 * r.normal(size=160)
    e = 100 / (1 + np.exp(-2 * a - 0.3 * r.normal(size=160)))
    return np.stack([a, b, c, d, e], 1)


def loo(x, y, alpha):
    """Mean squared leave-one-out error of a ridge with this penalty on standardised predictors, row by row."""
    z = (x - x.mean(0)) / x.std(0)
    z1 = np.hstack([np.ones((len(z), 1)), z])
    h = z1 @ np.linalg.inv(z1.T @ z1 + np.diag([0] + [alpha] * x.shape[1])) @ z1.T
    return float((((y - h @ y) / (1 - np.diag(h))) ** 2).mean())


def test_forward_selection_equals_a_plain_search(spark, matrix):
    df = frame(spark, matrix, "abcde").cache()
    got = bank.forward(df, "d", list("abce"))
    assert got[:2] == ["a", "b"]
    models = bank.linear_models(df, "d", [["a"], ["a", "b"], ["c"]])
    for cols, (model, error) in zip(([0], [0, 1], [2]), models, strict=True):
        assert abs(error - loo(matrix[:, cols], matrix[:, 3], model.penalty)) < 1e-3 * error
    assert bank.linear_models(df.limit(9), "d", [["a"]]) == [None]


def test_column_kinds_and_redundancy(spark, matrix):
    r = np.random.default_rng(0)
    x = np.hstack([matrix, np.exp(5 * matrix[:, :1]), r.integers(0, 3, (160, 1)), r.normal(size=(160, 1))])
    x[:80, 7] = np.nan
    df = frame(spark, x, "abcdefgh")
    got = {t["column"]: t["kind"] for t in bank.kinds(df, list("abcdefgh")).collect()}
    assert got["g"] == "CATEGORICAL" and got["d"] == "LINEAR" and got["f"] == "NONLINEAR" and got["h"] == "EXTRAPOLATION_PRONE"
    part = {(p["a"], p["b"]): p["r"] for p in bank.partial_correlations(df, list("abd")).collect()}
    inverse = np.linalg.inv(np.corrcoef(matrix[:, [0, 1, 3]].T) + 1e-4 * np.eye(3))
    want = -inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    assert abs(part["a", "b"] - want[0, 1]) < 1e-6 and abs(part["b", "d"] - want[1, 2]) < 1e-6
    shares = bank.contributions(df, "d", ["a", "b"])
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["a"] > shares["b"]
    assert bank.mrmr(df, "d", list("abce"), 3)[0] == "a" and len(set(bank.mrmr(df, "d", list("abce"), 3))) == 3


def plain_floor(v):
    v = np.sort(v)
    n, width = len(v), v[-1] - v[0]
    low = (v <= v[0] + 0.25 * width).sum()
    if n < 20 or low < 0.15 * n or n - low < 10:
        return None
    steps = [(v[k] - v[k - 1], -p, v[k]) for p in range(10, 45, 5) if 0 < (k := int(p / 100 * n)) < n - 10 and k / n >= 0.15]
    if not steps or max(steps)[0] < 0.05 * width:
        return None
    t = max(steps)[2]
    return (t, v[v <= t].mean()) if (v <= t).sum() >= 5 and (v > t).sum() >= 10 else None


def test_floors(spark):
    r = np.random.default_rng(1)
    cases = [np.concatenate([r.normal(0, 0.01, 20), r.normal(5, 1, 60)]), np.concatenate([r.normal(0, 0.01, 20), r.normal(5, 1, 80)]), r.normal(size=90), r.normal(size=12), np.zeros(40), np.concatenate([r.normal(0, 0.01, 30), r.normal(5, 1, 70)])]
    for v in cases:
        got, want = bank.floor_of(frame(spark, v[:, None], "v"), "v"), plain_floor(v) if v.std() else None
        assert (got is None) == (want is None) and (got is None or np.allclose(got, want))


def test_gates_of_several_targets_at_once(spark, matrix):
    wide = bank.Wide(frame(spark, matrix, "abcde"), list("abcde"))
    got = bank.gates(wide, [(["a", "b"], "d", lambda t: t > 0), (["c"], "a", lambda t: t > 0.5), (["a"], "b", lambda t: t > 99)])
    for gate, cols, y in zip(got, ([0, 1], [2]), (matrix[:, 3] > 0, matrix[:, 0] > 0.5), strict=False):
        z, y = (matrix[:, cols] - matrix[:, cols].mean(0)) / matrix[:, cols].std(0), y.astype(float)
        x, w = np.hstack([np.ones((160, 1)), z]), np.where(y > 0, 160 / (2 * y.sum()), 160 / (2 * (160 - y.sum())))
        p = 1 / (1 + np.exp(-x @ gate.beta))
        assert np.abs(x.T @ (w * (y - p)) - np.array([0] + [1] * len(cols)) * gate.beta).max() < 1e-5
    assert not got[2].beta.any()


def test_models_by_kind(spark, matrix):
    r = np.random.default_rng(3)
    kinds = np.digitize(matrix[:, 0], [-0.6, 0.6]).astype(float)
    cut = np.sort(matrix[:, 0])[48]  # three tenths stand at the floor
    x = np.column_stack([matrix[:, [0, 4]], np.where(matrix[:, 0] >= cut, 5 + matrix[:, 0], 0.0) + 0.001 * r.normal(size=160), kinds, (kinds > 0) * 7.0])
    df = frame(spark, x, "aefgh").cache()
    kind = dict.fromkeys("aef", "LINEAR") | {"g": "CATEGORICAL", "h": "CATEGORICAL"}
    found = bank.bank_of(df, list("aefgh"), kind, {c: c == "e" for c in "aefgh"}, 2)
    names = {c: {n for *_, n in own} for c, own in found.items()}
    assert names["f"] == {"hurdle"} and names["g"] == {"classes"} and names["h"] == {"binary"} and names["a"] == {"linear"}
    for c, j in (("f", 2), ("g", 3), ("h", 4)):
        _, model, error, _ = found[c][0]
        got = np.array([t[0] for t in df.orderBy("k").select(model.predicted()).collect()])
        assert np.corrcoef(got, x[:, j])[0, 1] > 0.85 and 0 <= error < x[:, j].var()
        assert c == "f" or set(got) <= set(x[:, j])
    low = next((m for _, m, _, n in bank.bank_of(df.select("k", "a", "e"), ["a", "e"], kind, {"a": False, "e": True}, 1)["e"] if n == "bounded"), None)
    fit = np.array([t[0] for t in df.orderBy("k").select(low.predicted()).collect()])
    assert (fit >= x[:, 1].min()).all() and (fit <= x[:, 1].max()).all() and np.corrcoef(fit, x[:, 1])[0, 1] > 0.95


def test_passes_do_not_grow_with_the_columns(spark, matrix, monkeypatch):
    passes = []
    run = bank.summed
    monkeypatch.setattr(bank, "summed", lambda *a: passes.append(1) or run(*a))
    for names in ("abc", "abcde"):
        df = frame(spark, matrix[:, : len(names)], names)
        bank.bank_of(df, list(names), dict.fromkeys(names, "LINEAR"), dict.fromkeys(names, False), 2)
        passes.append(0)
    at = passes.index(0)
    assert sum(passes[:at]) == sum(passes[at:]) == 4


def test_gaps_are_filled_in_two_passes(spark, matrix):
    x, r = matrix.copy(), np.random.default_rng(7)
    x[:40, 3] = np.nan
    x[:10, 0] = np.nan
    x[5:12, 1] = np.nan
    x[150:, 2] = np.nan
    cells = {(t["k"], t["column"]): t for t in bank.filled(frame(spark, x, "abcde"), "k", list("abcde")).collect()}
    assert len(cells) == 160 * 5
    for k in range(160):
        for j, c in enumerate("abcde"):
            t = cells[k, c]
            if not np.isnan(x[k, j]):
                assert t["origin"] == "observed" and t["value"] == x[k, j] and t["sigma2"] == 0
            else:
                assert t["sigma2"] >= 0 and np.isfinite(t["value"])
    e = np.array([cells[k, "d"]["value"] - matrix[k, 3] for k in range(12, 40)])
    assert np.sqrt((e**2).mean()) < 0.25
    second = [t for t in cells.values() if t["origin"].startswith("second")]
    assert all(t["sigma2"] < 0.95 * np.nanvar(x[:, "abcde".index(t["column"])], ddof=1) for t in second)
    assert r is not None


def test_completion_equals_a_plain_iteration(spark):
    r = np.random.default_rng(2)
    full = r.normal(size=(60, 2)) @ r.normal(size=(2, 5))
    x = np.where(r.random(full.shape) < 0.15, np.nan, full)
    df = frame(spark, x, "abcde")
    got = np.array([tuple(t)[1:] for t in bank.completed(df, "k", list("abcde"), 2, rounds=12, tolerance=0).orderBy("k").collect()])
    now = np.where(np.isnan(x), np.nanmedian(x, 0), x)
    sd = now.std(0)
    for _ in range(12):
        z = now / sd
        m = z.mean(0)
        v = np.linalg.svd(z - m, full_matrices=False)[2][:2]
        now = np.where(np.isnan(x), ((z - m) @ v.T @ v + m) * sd, x)
    assert np.allclose(got, now, atol=1e-6)
    assert np.abs(got - full)[np.isnan(x)].mean() < np.abs(np.nanmedian(x, 0) - full)[np.isnan(x)].mean() / 3
