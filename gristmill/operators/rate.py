"""Battles: canonical pairs, paired results, and skill ratings folded in time order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MU, SIGMA = 25.0, 25.0 / 3


def ordered_pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("model_1"), F.greatest(a, b).alias("model_2"), (F.col(a) < F.col(b)).alias("forward")]


def win_loss(battles: DataFrame) -> DataFrame:
    """model, wins, losses, total, win_rate from rows with ``winner`` and ``loser``."""
    sides = battles.select(F.explode(F.array(F.struct(F.col("winner").alias("model"), F.lit(1).alias("won")), F.struct(F.col("loser").alias("model"), F.lit(0).alias("won")))).alias("s")).select("s.*")
    out = sides.groupBy("model").agg(F.sum("won").alias("wins"), F.count("*").alias("total"))
    return out.select("model", "wins", (F.col("total") - F.col("wins")).alias("losses"), "total", F.round(F.col("wins") / F.col("total"), 6).alias("win_rate"))


def paired_results(battles: DataFrame) -> DataFrame:
    """Pairs judged in both orientations: the i-th forward with the i-th reverse battle of an item, in time order.

    Input: item, model_a, model_b, margin_a, margin_b, seq. Margins are summed over both orientations; the larger
    sum wins, equal ones draw.
    """
    canonical = battles.select("item", "seq", *ordered_pair("model_a", "model_b"), F.when(F.col("model_a") < F.col("model_b"), F.col("margin_a")).otherwise(F.col("margin_b")).alias("m1"), F.when(F.col("model_a") < F.col("model_b"), F.col("margin_b")).otherwise(F.col("margin_a")).alias("m2"))
    keys = ["item", "model_1", "model_2"]
    nth = canonical.withColumn("i", F.row_number().over(Window.partitionBy(*keys, "forward").orderBy("seq")))
    both = nth.groupBy(*keys, "i").agg(F.count("*").alias("n"), F.sum("m1").alias("margin_1"), F.sum("m2").alias("margin_2"), F.max("seq").alias("seq")).where("n = 2")
    result = F.when(F.col("margin_1") > F.col("margin_2"), "model_1").when(F.col("margin_1") < F.col("margin_2"), "model_2").otherwise("draw")
    return both.select(*keys, "i", "margin_1", "margin_2", "seq", result.alias("result"))


def density(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def below(x: float) -> float:
    return math.erfc(-x / math.sqrt(2)) / 2


def quantile(p: float) -> float:
    """Of the normal distribution, by bisection."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


def skill_update(a: tuple[float, float], b: tuple[float, float], draw: bool, margin: float, beta: float, tau: float) -> tuple[tuple[float, float], tuple[float, float]]:
    """Both players' (mu, sigma) after ``a`` beat ``b`` or drew: moments of the truncated difference."""
    va, vb = a[1] ** 2 + tau**2, b[1] ** 2 + tau**2
    c = math.sqrt(va + vb + 2 * beta**2)
    t, e = (a[0] - b[0]) / c, margin / c
    if draw:
        mass = max(below(e - t) - below(-e - t), 1e-12)
        v = (density(-e - t) - density(e - t)) / mass
        w = v * v + ((e - t) * density(e - t) + (e + t) * density(e + t)) / mass
    else:
        mass = max(below(t - e), 1e-12)
        v = density(t - e) / mass
        w = v * (v + t - e)
    w = min(max(w, 0.0), 1 - 1e-9)
    step = lambda m, x, s: (m + s * x / c * v, math.sqrt(x * (1 - x / c**2 * w)))
    return step(a[0], va, 1), step(b[0], vb, -1)


RATINGS = "model string, mu double, sigma double, games long"


def played(rate: dict[str, tuple[float, float, int]], rows: pd.DataFrame, draw_probability: float) -> dict[str, tuple[float, float, int]]:
    """Ratings (mu, sigma, games) after these results, one after the other in the order of ``seq``."""
    beta, tau = SIGMA / 2, SIGMA / 100
    margin = quantile((draw_probability + 1) / 2) * math.sqrt(2) * beta
    for r in rows.sort_values(["seq", "model_1", "model_2"]).itertuples():
        one, two = (r.model_2, r.model_1) if r.result == "model_2" else (r.model_1, r.model_2)
        a, b = rate.get(one, (MU, SIGMA, 0)), rate.get(two, (MU, SIGMA, 0))
        x, y = skill_update(a[:2], b[:2], r.result == "draw", margin, beta, tau)
        rate[one], rate[two] = (*x, a[2] + 1), (*y, b[2] + 1)
    return rate


def as_rows(group: str, key: object, rate: dict[str, tuple[float, float, int]]) -> pd.DataFrame:
    names = sorted(rate)
    return pd.DataFrame({group: [key] * len(names), "model": names, "mu": [rate[m][0] for m in names], "sigma": [rate[m][1] for m in names], "games": [rate[m][2] for m in names]})


def skill_ratings(results: DataFrame, group: str, draw_probability: float = 0.1) -> DataFrame:
    """(group, model, mu, sigma, games): ratings folded over the results of each group in the order of ``seq``.

    The fold is sequential by nature, so that a group (a judge, an axis) is one task; groups run side by side. A long
    history goes through ``continued`` in batches instead. Input: group, seq, model_1, model_2, result. Equal ``seq``
    are ordered by the names.
    """

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return as_rows(group, key[0], played({}, rows, draw_probability))

    own = results.select(group, "seq", "model_1", "model_2", "result")
    kind = own.schema[group].dataType.simpleString()
    return own.groupBy(group).applyInPandas(fold, f"`{group}` {kind}, {RATINGS}")


def continued(ratings: DataFrame, results: DataFrame, group: str, draw_probability: float = 0.1) -> DataFrame:
    """The ratings (group, RATINGS) after a batch of later results: only the batch's rows are gathered by group, so
    that a task's size does not grow with the history. Groups without new results stay as they are."""

    def fold(key: tuple, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rate = {r.model: (r.mu, r.sigma, int(r.games)) for r in old.itertuples()}
        return as_rows(group, key[0], played(rate, rows, draw_probability))

    own = results.select(group, "seq", "model_1", "model_2", "result")
    kind = own.schema[group].dataType.simpleString()
    touched = ratings.join(own.select(group).distinct(), group, "left_semi")
    new = touched.groupBy(group).cogroup(own.groupBy(group)).applyInPandas(fold, f"`{group}` {kind}, {RATINGS}")
    return new.unionByName(ratings.join(own.select(group).distinct(), group, "left_anti"))


def bradley_terry(results: DataFrame, group: str, ridge: float = 1.0, rounds: int = 60) -> DataFrame:
    """(group, model, strength): ridge-penalised maximum likelihood on win counts of pairs, draws as half wins.

    Battles are first summed up to one row for each pair and side, so that a group's kernel sees models squared
    at most, not battles.
    """
    half = F.when(F.col("result") == "draw", 0.5)
    counts = results.groupBy(group, "model_1", "model_2").agg(
        F.sum(F.coalesce(half, (F.col("result") == "model_1").cast("double"))).alias("w1"), F.sum(F.coalesce(half, (F.col("result") == "model_2").cast("double"))).alias("w2")
    )

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows["model_1"]) | set(rows["model_2"]))
        at = {m: k for k, m in enumerate(names)}
        i, j = rows["model_1"].map(at).to_numpy(), rows["model_2"].map(at).to_numpy()
        w1, w2 = rows["w1"].to_numpy(), rows["w2"].to_numpy()
        s = np.zeros(len(names))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(s[j] - s[i]))
            pull = w1 * (1 - p) - w2 * p
            g, h = -ridge * s, np.eye(len(names)) * ridge
            np.add.at(g, i, pull)
            np.add.at(g, j, -pull)
            c = (w1 + w2) * p * (1 - p)
            for x, y, sign in ((i, i, 1), (j, j, 1), (i, j, -1), (j, i, -1)):
                np.add.at(h, (x, y), sign * c)
            step = np.linalg.solve(h, g)
            s += step
            if np.abs(step).max() < 1e-10:
                break
        return pd.DataFrame({group: [key[0]] * len(names), "model": names, "strength": s})

    kind = counts.schema[group].dataType.simpleString()
    return counts.groupBy(group).applyInPandas(solve, f"`{group}` {kind}, model string, strength double")


def controlled_strengths(battles: DataFrame, covariates: list[str], key: str, penalty: float = 1.0) -> tuple[DataFrame, dict[str, float]]:
    """(model, strength) by logistic regression on the difference of the models and z-scored covariate deltas, and
    the covariates' weights.

    Input: winner, loser, the covariates as winner minus loser, and a key whose hash decides which side is first.
    Models are few (a column each); battles stay spread out.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = sorted(r[0] for r in battles.select(F.explode(F.array("winner", "loser"))).distinct().collect())
    stats = battles.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in covariates], *[F.stddev(c).alias(f"s_{c}") for c in covariates]).first()
    first = F.pmod(F.xxhash64(key), F.lit(2)) == 0
    way = F.when(first, 1.0).otherwise(-1.0)
    sides = [(way * ((F.col("winner") == m).cast("double") - (F.col("loser") == m).cast("double"))).alias(f"m{i}") for i, m in enumerate(names)]
    deltas = [(way * (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0)).alias(f"c{i}") for i, c in enumerate(covariates)]
    rows = battles.select(first.cast("double").alias("label"), *sides, *deltas)
    inputs = [c for c in rows.columns if c != "label"]
    data = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows).select("label", "features")
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=penalty / max(1, stats["n"])).fit(data)
    w = model.coefficients.toArray().tolist()
    strengths = battles.sparkSession.createDataFrame(list(zip(names, w, strict=False)), "model string, strength double")
    return strengths, dict(zip(covariates, w[len(names) :], strict=True))
