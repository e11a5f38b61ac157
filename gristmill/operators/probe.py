"""Probes: what of an outcome a vector tells. Logistic fits of all folds at once, and ridges that leave one row out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.latent import logistic, ridge, summed


def stack(f: pd.DataFrame) -> np.ndarray:
    return np.array([list(v) for v in f["x"]], np.float64)


def fold_logits(rows: DataFrame, dims: int, folds: int, strength: float = 1.0, rounds: int = 40, tolerance: float = 1e-9) -> list[tuple[np.ndarray, float]]:
    """For each fold the logistic fit to all rows (x, y 0 or 1, fold) but its own: weights and level.

    Minimises |w|^2 / 2 + strength * loss, the level free, by Newton steps; one pass sums gradients and second
    derivatives of all folds. A step that raises a fold's loss is halved."""
    k = dims + 1
    now = np.zeros((folds, k))
    before, losses, open_ = now.copy(), np.full(folds, np.inf), np.ones(folds, bool)

    for _ in range(rounds):
        beta = now

        def add(f: pd.DataFrame, beta=beta) -> np.ndarray:
            one, y, fold = np.c_[stack(f), np.ones(len(f))], f["y"].to_numpy(np.float64), f["fold"].to_numpy()
            out = []
            for g in range(folds):
                a, t = one[fold != g], y[fold != g]
                s = a @ beta[g]
                p = logistic(s)
                out += [((a * (p * (1 - p))[:, None]).T @ a).ravel(), a.T @ (p - t), [(np.logaddexp(0, s) - t * s).sum()]]
            return np.concatenate(out)

        sums = summed(rows, ["x", "y", "fold"], add, folds * (k * k + k + 1)).reshape(folds, -1)
        for g in np.flatnonzero(open_):
            bend, slope, loss = sums[g, : k * k].reshape(k, k), sums[g, k * k : -1], sums[g, -1]
            own = np.r_[now[g, :-1], 0.0]
            loss = strength * loss + own @ own / 2
            if loss > losses[g] + 1e-12 * abs(losses[g]):
                now[g] = (now[g] + before[g]) / 2
                continue
            open_[g] = losses[g] - loss > tolerance * max(1.0, loss)
            losses[g], before[g] = loss, now[g]
            if open_[g]:
                now = now.copy()
                now[g] = now[g] - np.linalg.solve(strength * bend + np.diag(np.r_[np.ones(dims), 1e-12]), strength * slope + own)
        if not open_.any():
            break
    return [(b[:-1], float(b[-1])) for b in before]


def fold_accuracy(rows: DataFrame, fits: list[tuple[np.ndarray, float]]) -> DataFrame:
    """(fold, n, accuracy): how often each fold's rows fall on the right side of the fit that has not seen them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                w, b = np.stack([w for w, _ in fits]), np.array([b for _, b in fits])
                fold = f["fold"].to_numpy()
                yield pd.DataFrame({"fold": fold, "right": (((stack(f) * w[fold]).sum(1) + b[fold] > 0) == (f["y"].to_numpy() > 0.5)).astype(np.int64)})

    told = rows.select("x", "y", "fold").mapInPandas(run, "fold int, right long")
    return told.groupBy("fold").agg(F.count("*").alias("n"), F.avg("right").alias("accuracy"))


def left_out(rows: DataFrame, key: str, dims: int, penalty: float = 1.0) -> DataFrame:
    """(key, actual, predicted) of rows (key, x, y): each by the ridge on all others. One pass sums the products; a
    row's own part is then taken out of them by its leverage."""
    k = dims + 2

    def add(f: pd.DataFrame) -> np.ndarray:
        one = np.c_[np.ones(len(f)), stack(f), f["y"].to_numpy(np.float64)]
        return (one.T @ one).ravel()

    q = summed(rows, ["x", "y"], add, k * k).reshape(k, k)
    n = q[0, 0]
    mean = q[0] / max(n, 1)
    w, b = ridge(q, penalty)
    spread = np.linalg.inv(q[1:-1, 1:-1] - n * np.outer(mean[1:-1], mean[1:-1]) + penalty * np.eye(dims))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x, y = stack(f), f["y"].to_numpy(np.float64)
                c = x - mean[1:-1]
                h = np.einsum("ij,jk,ik->i", c, spread, c) + 1 / n
                with np.errstate(divide="ignore", invalid="ignore"):
                    yield f[[key]].assign(actual=y, predicted=y - (y - x @ w - b) / (1 - h))

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "x", "y").mapInPandas(run, f"`{key}` {kind}, actual double, predicted double")
