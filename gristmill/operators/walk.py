"""Honest walk-forward: every row is predicted by a model of all rows that came before its time, and of no others.

A linear model needs no rows but their products. These are summed by time, then before each time: ranges of times are
summed up, the sums before a range are added on the driver (one array a range), and inside a range they accumulate. So
each refit is a lookup, and the table is read once, however many steps there are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.impute import square
from gristmill.operators.predict import components
from gristmill.operators.rank import edges, range_of
from gristmill.tables import stored

#: Times of one range, which one task goes through.
STEPS = 512
#: Models of more bytes than this meet their rows in a join instead of going to all tasks.
SENT = 8 << 20


def fitted(products: np.ndarray, penalty: float, parts: int) -> np.ndarray:
    """Level and weights of the raw features, from the products of (1, features, target) with themselves.

    Ridge on standardised features; with ``parts`` > 0 the least squares on that many PLS components instead. A feature
    without spread has no weight; without rows all is null."""
    n, k = products[0, 0], len(products) - 2
    if n < 1:
        return np.full(k + 1, np.nan)
    mean = products[0] / n
    spread = products / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(spread)[1:-1], 0))
    flat = sd <= 1e-12 * np.maximum(1, np.abs(mean[1:-1]))
    sd[flat] = 1.0
    gram, cross = spread[1:-1, 1:-1] / np.outer(sd, sd), spread[1:-1, -1] / sd
    gram[flat], gram[:, flat], cross[flat] = 0, 0, 0
    if parts:
        turn = components(gram, cross, parts)
        beta = turn @ np.linalg.lstsq(turn.T @ gram @ turn, turn.T @ cross, rcond=None)[0] if turn.shape[1] else np.zeros(k)
    else:
        beta = np.linalg.solve(n * gram + max(penalty, 1e-12) * np.eye(k), n * cross)
    beta = beta / sd
    return np.r_[mean[-1] - mean[1:-1] @ beta, beta]


def models(own: DataFrame, k: int, penalty: float, parts: int) -> DataFrame:
    """(t, n_train, weights) for every time t of rows (t, x0 .. , y): fitted to the rows before it."""
    terms = [F.lit(1.0), *[F.col(f"x{i}") for i in range(k)], F.col("y")]
    sums = F.array(*[F.sum(terms[i] * terms[j]) for i in range(k + 2) for j in range(i + 1)])
    by_time = stored(own.groupBy("t").agg(sums.alias("s")), "time-products")
    n = by_time.count()
    bounds = edges(by_time, "t", -(-n // STEPS)) if n > STEPS else []
    ranged = by_time.withColumn("range", range_of(F.col("t"), bounds) if bounds else F.lit(0))
    size = (k + 2) * (k + 3) // 2
    total: dict[int, np.ndarray] = {}
    for r in ranged.select("range", F.posexplode("s").alias("at", "v")).groupBy("range", "at").agg(F.sum("v").alias("v")).collect():
        total.setdefault(r["range"], np.zeros(size))[r["at"]] = r["v"]
    before, now = {}, np.zeros(size)
    for at in sorted(total):
        before[at] = now
        now = now + total[at]

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        s = np.array([list(v) for v in f["s"]])
        earlier = before[key[0]] + np.cumsum(s, axis=0) - s
        return pd.DataFrame({"t": f["t"], "n_train": earlier[:, 0].round().astype(np.int64), "weights": [fitted(square(e), penalty, parts) for e in earlier]})

    return ranged.groupBy("range").applyInPandas(run, "t double, n_train long, weights array<double>")


def walk_forward(df: DataFrame, key: str, time: Column, features: Sequence[str], target: str, first: float = 0.8, penalty: float = 1.0, parts: int = 0) -> DataFrame:
    """(key, t, actual, predicted, n_train) of the newest rows: those before whose time (a number; the finer it is, the
    more steps) lies the share ``first`` of all rows. Rows with a null anywhere are left out."""
    k = len(features)
    own = df.select(F.col(key).alias("key"), time.cast("double").alias("t"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("y")).dropna(subset=["t", "y", *[f"x{i}" for i in range(k)]])
    own = stored(own, "walk-rows")
    least = int(first * own.count())
    steps = stored(models(own, k, penalty, parts).where((F.col("n_train") >= least) & (F.col("n_train") > 0)), "walk-models")
    if steps.count() * (8 * k + 48) <= SENT:
        steps = F.broadcast(steps)
    met = own.join(steps, "t")
    predicted = sum((F.col(f"x{i}") * F.get("weights", F.lit(i + 1)) for i in range(k)), F.get("weights", F.lit(0)))
    return met.select(F.col("key").alias(key), "t", F.col("y").alias("actual"), predicted.alias("predicted"), "n_train")


def walk_errors(predictions: DataFrame) -> DataFrame:
    """n, rmse, mae, r2 and the correlation of predictions with what came: one row, null where there are none."""
    e = F.col("actual") - F.col("predicted")
    return predictions.agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.avg(e * e) / F.var_pop("actual")).alias("r2"), F.corr("actual", "predicted").alias("r"),
    )
