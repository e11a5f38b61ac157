"""Probes fold by fold, pairs by overlap and the bootstrap against plain versions."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from gristmill.operators import bootstrap, overlap, probe


def plain_logit(x, y, strength):
    one, beta = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    free = np.diag(np.r_[np.ones(x.shape[1]), 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-one @ beta))
        beta = beta - np.linalg.solve(strength * (one * (p * (1 - p))[:, None]).T @ one + free, strength * one.T @ (p - y) + free @ beta)
    return beta


@pytest.mark.parametrize("strength", [1.0, 0.05, 50.0])
def test_all_folds_at_once_are_each_fold_alone(spark, strength):
    r = np.random.default_rng(1)
    x, fold = r.normal(size=(300, 4)) * [1, 3, 0.2, 1], r.integers(0, 3, 300)
    y = (x @ [1.0, -0.5, 2.0, 0.0] + 0.3 + r.logistic(size=300) > 0).astype(float)
    rows = spark.createDataFrame([([float(v) for v in a], float(b), int(g)) for a, b, g in zip(x, y, fold, strict=True)], "x array<double>, y double, fold int").cache()
    fits = probe.fold_logits(rows, 4, 3, strength)
    told = {v["fold"]: v for v in probe.fold_accuracy(rows, fits).collect()}
    for g, (w, b) in enumerate(fits):
        beta = plain_logit(x[fold != g], y[fold != g], strength)
        assert np.allclose(w, beta[:-1], atol=1e-5) and b == pytest.approx(beta[-1], abs=1e-5)
        right = (x[fold == g] @ beta[:-1] + beta[-1] > 0) == (y[fold == g] > 0.5)
        assert told[g]["n"] == len(right) and told[g]["accuracy"] == pytest.approx(right.mean())


def test_left_out_rows_are_told_by_the_others(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(25, 6))
    y = x @ r.normal(size=6) + r.normal(size=25)
    rows = spark.createDataFrame([(k, [float(v) for v in a], float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "k long, x array<double>, y double")
    got = {v["k"]: v["predicted"] for v in probe.left_out(rows, "k", 6).collect()}
    for k in range(25):
        rest = np.arange(25) != k
        c = x[rest] - x[rest].mean(0)
        w = np.linalg.solve(c.T @ c + np.eye(6), c.T @ (y[rest] - y[rest].mean()))
        assert got[k] == pytest.approx(y[rest].mean() + (x[k] - x[rest].mean(0)) @ w)
    assert probe.left_out(rows.limit(0), "k", 6).count() == 0


@pytest.mark.parametrize("part,least", [(512, 3), (3, 3), (4, 1), (7, 6)])
def test_overlaps_are_those_of_all_pairs(spark, monkeypatch, part, least):
    monkeypatch.setattr(overlap, "PART", part)
    r = np.random.default_rng(part)
    sets = {k: {f"i{min(int(v), 30)}" for v in r.exponential(6, r.integers(1, 14))} | ({"hot"} if k % 3 else set()) for k in range(60)}
    rows = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s], "k long, item string")
    got = {(v["left_id"], v["right_id"]): v["shared"] for v in overlap.overlapping(rows, "k", "item", least).collect()}
    assert got == {(a, b): len(sets[a] & sets[b]) for a, b in combinations(range(60), 2) if len(sets[a] & sets[b]) >= least}
    n = Counter(i for s in sets.values() for i in s)
    told = overlap.work(rows, "k", "item", least).first()
    assert told["pairs_of_items"] == sum(v * (v - 1) // 2 for v in n.values()) and told["pairs_of_prefixes"] <= told["pairs_of_items"]
    assert overlap.overlapping(rows.limit(0), "k", "item", least).count() == 0


def test_draws_are_poisson_counts_and_their_sums_the_table_s(spark):
    w = bootstrap.counts(np.arange(5000), 300)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(w[:, :40].T)[np.triu_indices(40, 1)]).max() < 0.08 and abs(np.corrcoef(w[:200])[np.triu_indices(200, 1)]).mean() < 0.06
    v = np.random.default_rng(3).normal(size=400)
    df = spark.createDataFrame([(k, float(t)) for k, t in enumerate(v)] + [(None, 1.0), (400, None)], "k long, v double")
    got = bootstrap.resampled(df, "k", [df["v"]], 50)
    assert np.allclose(got[0], v @ bootstrap.counts(np.arange(400), 50))
    means = bootstrap.resampled(df, "k", [df["v"]], 1000)[0] / 400
    assert means.std() == pytest.approx(v.std() / 20, rel=0.15) and bootstrap.resampled(df.limit(0), "k", [df["v"]], 9).sum() == 0


@pytest.mark.parametrize("part,copies", [(512, 1), (3, 1), (2, 7), (512, 7)])
def test_equal_sets_meet_the_others_once(spark, monkeypatch, part, copies):
    monkeypatch.setattr(overlap, "PART", part)
    r = np.random.default_rng(copies)
    kinds = [set(r.choice(12, r.integers(1, 9), replace=False).tolist()) for _ in range(20)]
    sets = {k: kinds[k % len(kinds)] for k in range(20 * copies if copies > 1 else 27)}
    rows = spark.createDataFrame([(k, f"i{i}") for k, s in sets.items() for i in s], "k long, item string")
    got = [tuple(v) for v in overlap.overlapping(rows, "k", "item", 3).select("left_id", "right_id", "shared").collect()]
    assert sorted(got) == [(a, b, len(sets[a] & sets[b])) for a, b in combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 3]
    classes = overlap.classes_of(overlap.prefixes(rows, "k", "item", 3), "k")
    assert classes.count() == len({frozenset(s) for s in kinds if len(s) >= 3})


def test_sets_are_not_sent_more_often_when_there_are_more(spark, monkeypatch):
    """Six times the sets meet in as many parts, in pieces of four; keys may be strings."""
    monkeypatch.setattr(overlap, "PART", 2)
    monkeypatch.setattr(overlap, "MOST_PARTS", 2)
    told, met = [], overlap.met
    monkeypatch.setattr(overlap, "met", lambda classes, least, parts: told.append(parts) or met(classes, least, parts))
    r = np.random.default_rng(9)
    for n in (40, 240):
        sets = {f"k{k:03}": set(r.choice(12, r.integers(5, 9), replace=False).tolist()) for k in range(n)}
        rows = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s], "k string, item long")
        got = sorted(tuple(v) for v in overlap.overlapping(rows, "k", "item", 2).select("left_id", "right_id", "shared").collect())
        assert got == [(a, b, len(sets[a] & sets[b])) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 2]
    assert told == [4, 4]
    monkeypatch.undo()
    assert overlap.parts_of(90_000, 5_000_000) == overlap.parts_of(540_000, 30_000_000) == 48
    assert 10**8 / overlap.parts_of(10**8, 10**9) <= 1 << 15 and 10**9 / overlap.parts_of(1000, 10**9) <= 1 << 23
