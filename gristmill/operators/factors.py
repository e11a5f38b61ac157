"""Factors, families, chained regressions and cross-validated fits: all from products of columns that one aggregation
gives, so that what is fitted on the driver has the size of the schema."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.correlate import pairs
from gristmill.operators.exact import medians, quantiles
from gristmill.operators.impute import square


def correlations(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The matrix of pairwise-complete correlations."""
    at, m = {c: i for i, c in enumerate(columns)}, np.eye(len(columns))
    for r in pairs(df, columns).collect():  # a row a pair of columns
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["r"] or 0.0
    return m


def varimax(loadings: np.ndarray, rounds: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """The loadings turned so that the variance of their squares is greatest."""
    n, k = loadings.shape
    turn, before = np.eye(k), 0.0
    for _ in range(rounds):
        x = loadings @ turn
        u, s, v = np.linalg.svd(loadings.T @ (x**3 - x * (x**2).sum(0) / n))
        turn = u @ v
        if s.sum() < before * (1 + tolerance):
            break
        before = s.sum()
    return loadings @ turn


def factor_loadings(r: np.ndarray, k: int, rounds: int = 2000, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (columns, factors) and the columns' own variances of a maximum-likelihood factor model of a correlation
    matrix, by expectation and maximisation; turned by varimax, each factor's mean loading positive."""
    values, vectors = np.linalg.eigh(r)
    load = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 1e-9))
    own = np.maximum(1 - (load**2).sum(1), 0.05)
    for _ in range(rounds):
        b = load.T @ np.linalg.inv(load @ load.T + np.diag(own))
        z = np.eye(k) - b @ load + b @ r @ b.T
        new = r @ b.T @ np.linalg.inv(z)
        fresh = np.maximum(np.diag(r - new @ b @ r), 1e-6)
        moved = np.abs(new - load).max() + np.abs(fresh - own).max()
        load, own = new, fresh
        if moved < tolerance:
            break
    load = varimax(load) if k > 1 else load
    return load * np.where(load.mean(0) < 0, -1, 1), own


def factor_scores(df: DataFrame, key: str, columns: Sequence[str], k: int) -> DataFrame:
    """(key, f1, f2, ...) by regression on the standardised columns; rows with gaps are left out."""
    own = df.dropna(subset=list(columns))
    load, _ = factor_loadings(r := correlations(own, columns), k)
    weights = np.linalg.solve(r + 1e-9 * np.eye(len(columns)), load)
    s = own.agg(*[x.alias(f"{n}{i}") for i, c in enumerate(columns) for n, x in (("m", F.avg(c)), ("s", F.stddev_pop(c)))]).first()
    z = [(F.col(c).cast("double") - s[f"m{i}"]) / (s[f"s{i}"] or 1.0) for i, c in enumerate(columns)]
    return own.select(key, *[sum((x * float(w) for x, w in zip(z, weights[:, j], strict=True)), F.lit(0.0)).alias(f"f{j + 1}") for j in range(k)])


def agglomerated(distance: np.ndarray, clusters: int, linkage: str = "ward") -> list[int]:
    """Cluster numbers, in the order in which clusters first appear: the two closest are joined until so many are left.
    ``ward``: by the growth of the squared distances within; ``average``: by the mean distance."""
    d, size = distance.astype(float).copy(), np.ones(len(distance))
    label, alive = np.arange(len(d)), np.ones(len(d), bool)
    np.fill_diagonal(d, np.inf)
    for _ in range(len(d) - clusters):
        open_ = np.where(alive[:, None] & alive[None, :], d, np.inf)
        i, j = sorted(np.unravel_index(open_.argmin(), d.shape))
        n, m = size[i], size[j]
        if linkage == "ward":
            with np.errstate(invalid="ignore"):
                new = np.sqrt(((n + size) * d[i] ** 2 + (m + size) * d[j] ** 2 - size * d[i, j] ** 2) / (n + m + size))
        else:
            new = (n * d[i] + m * d[j]) / (n + m)
        d[i], d[:, i] = new, new
        d[i, i], size[i], alive[j] = np.inf, n + m, False
        label[label == j] = i
    first = list(dict.fromkeys(label.tolist()))
    return [first.index(x) for x in label.tolist()]


def families(df: DataFrame, columns: Sequence[str], clusters: int, linkage: str = "ward") -> dict[str, int]:
    """Families of columns that say alike, by 1 - |r|."""
    return dict(zip(columns, agglomerated(1 - np.abs(correlations(df, columns)), clusters, linkage), strict=True))


def chained(df: DataFrame, key: str, columns: Sequence[str], rounds: int = 10, ridge: float = 1e-3) -> DataFrame:
    """(key, columns): gaps by regressions of each column on all others, over and over. Gaps begin at the median; a
    round takes the products of all columns as they are (one aggregation), and judges all gaps on that state."""
    spark, middle, n = df.sparkSession, medians(df, columns), len(columns)
    keep = (lambda x: x.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda x: x.cache())
    own = keep(df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(middle[c]), F.lit(0.0)).alias(c) for c in columns], *[F.col(c).isNull().alias(f"{c}__gone") for c in columns]))
    for _ in range(rounds):
        x = [F.col(c) for c in columns]
        sums = own.agg(F.array(*[F.avg(v) for v in x]).alias("m"), F.array(*[F.covar_pop(x[i], x[j]) for i in range(n) for j in range(i + 1)]).alias("g")).first()
        mean, g = np.array(sums["m"]), square(sums["g"])
        out = []
        for i, c in enumerate(columns):
            rest = [j for j in range(n) if j != i]
            a = g[np.ix_(rest, rest)]
            beta = np.linalg.solve(a + ridge * np.diag(np.diag(a)) + 1e-12 * np.eye(n - 1), g[rest, i])
            fit = sum(((x[j] - float(mean[j])) * float(b) for j, b in zip(rest, beta, strict=True)), F.lit(float(mean[i])))
            out.append(F.when(F.col(f"{c}__gone"), fit).otherwise(x[i]).alias(c))
        own = keep(own.select(key, *out, *[f"{c}__gone" for c in columns]))
    return own.select(key, *columns)


def fold_products(df: DataFrame, columns: Sequence[str], target: str, fold: Column, folds: int) -> np.ndarray:
    """(folds, p, p) sums of products of (1, columns, target) over the complete rows of each fold."""
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in (*columns, target)]]
    p = len(terms)
    rows = df.dropna(subset=[*columns, target]).groupBy(fold.alias("__fold")).agg(F.array(*[F.sum(terms[i] * terms[j]) for i in range(p) for j in range(i + 1)]).alias("g")).collect()
    out = np.zeros((folds, p, p))
    for r in rows:  # a row a fold
        out[int(r["__fold"])] = square(r["g"])
    return out


def held_out(products: np.ndarray, use: Sequence[int], alpha: float = 0.0) -> tuple[float, float]:
    """Root mean squared error and R2 of ridges on the columns numbered in ``use``, each fitted without one fold and
    judged on it, from the folds' products alone."""
    total, rss, last = products.sum(0), 0.0, products.shape[1] - 1
    at = [0, *[u + 1 for u in use]]
    for own in products:
        m = total - own
        n = m[0, 0]
        sd = np.sqrt(np.maximum(np.diag(m)[at] / n - (m[0, at] / n) ** 2, 1e-12))
        keep = np.diag(np.concatenate(([0.0], alpha * sd[1:] ** 2)))
        beta = np.linalg.solve(m[np.ix_(at, at)] + keep + 1e-9 * np.eye(len(at)), m[at, last])
        rss += own[last, last] - 2 * beta @ own[at, last] + beta @ own[np.ix_(at, at)] @ beta
    n = total[0, 0]
    tss = total[last, last] - total[0, last] ** 2 / n
    return math.sqrt(max(rss, 0.0) / n), float(1 - rss / tss)


def ridge_cv(df: DataFrame, columns: Sequence[str], target: str, fold: Column, folds: int, alphas: Sequence[float]) -> tuple[float, float, float]:
    """The penalty with the least held-out error, that error and its R2: one pass for all penalties and folds."""
    g = fold_products(df, columns, target, fold, folds)
    error, alpha = min((held_out(g, range(len(columns)), a)[0], a) for a in alphas)
    return alpha, error, held_out(g, range(len(columns)), alpha)[1]


def incremental_r2(df: DataFrame, clusters: Sequence[Sequence[str]], target: str, fold: Column, folds: int) -> list[float]:
    """Held-out R2 as one cluster of columns after the other comes in: one pass for all steps."""
    columns = [c for own in clusters for c in own]
    g = fold_products(df, columns, target, fold, folds)
    ends = np.cumsum([len(own) for own in clusters])
    return [held_out(g, range(e))[1] for e in ends]


def smoothed(df: DataFrame, x: str, y: str, share: float = 0.6, ranges: int = 128) -> list[tuple[float, float]]:
    """(x, y) of a locally weighted line: rows are summed up in ``ranges`` ranges of x with about as many rows each, and
    at each range's mean a line is fitted to the nearest ranges that hold ``share`` of the rows, by tricube weights."""
    own = df.dropna(subset=[x, y])
    edges = sorted(set(quantiles(own, {x: [k / ranges for k in range(1, ranges)]})[x]))
    place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: F.col(x) > e)) if edges else F.lit(0)
    v, w = F.col(x).cast("double"), F.col(y).cast("double")
    rows = own.groupBy(place.alias("p")).agg(F.count("*").alias("n"), F.sum(v), F.sum(w), F.sum(v * v), F.sum(v * w)).orderBy("p").collect()
    s = np.array([tuple(r)[1:] for r in rows], float)
    at = s[:, 1] / s[:, 0]
    out = []
    for p in at:
        d = np.abs(at - p)
        near = np.argsort(d, kind="stable")
        last = min(len(d) - 1, int(np.searchsorted(np.cumsum(s[near, 0]), share * s[:, 0].sum())))
        reach = max(d[near[last]], 1e-12)
        t = (1 - np.minimum(d / reach, 1) ** 3) ** 3
        n, sx, sy, sxx, sxy = (s * t[:, None]).sum(0)
        spread = sxx - sx * sx / n
        slope = (sxy - sx * sy / n) / spread if spread > 1e-12 * max(1.0, sxx) else 0.0
        out.append((float(p), float(sy / n + slope * (p - sx / n))))
    return out


def in_original_units(beta: Sequence[float], intercept: float, mean: Sequence[float], sd: Sequence[float]) -> tuple[list[float], float]:
    """Coefficients on standardised columns as those on the columns themselves, with the intercept that goes with them."""
    own = [b / s for b, s in zip(beta, sd, strict=True)]
    return own, intercept - sum(b * m for b, m in zip(own, mean, strict=True))
