"""Components, clusters, neighbours and hulls."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.impute import square
from gristmill.operators.metric import MetricIndex


def principal_components(df: DataFrame, key: str, columns: Sequence[str], n: int) -> tuple[DataFrame, np.ndarray]:
    """(key, pc1, pc2, ...) of standardised columns, and the shares of variance of all components.

    The correlation matrix comes from one aggregation; its eigenvectors, each turned so that its greatest loading is
    positive, go back as expressions. Rows with a null anywhere are left out.
    """
    own = df.dropna(subset=list(columns)).select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    stats = own.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    z = [(F.col(c) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0) for i, c in enumerate(columns)]
    sums = own.agg(F.array(*[F.avg(z[i] * z[j]) for i in range(len(z)) for j in range(i + 1)])).first()[0]
    values, vectors = np.linalg.eigh(square(sums))
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(z))])
    scores = [sum((x * F.lit(float(v)) for x, v in zip(z, vectors[:, k], strict=True)), F.lit(0.0)).alias(f"pc{k + 1}") for k in range(n)]
    return own.select(key, *scores), values / values.sum()


def category_profiles(df: DataFrame, key: str, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """(key, one column a category): the first component of the category's z-scores (missing ones 0), turned so that
    it goes with their mean, on a scale of 0 to 100 over all rows; 50 where it is the same for all. All categories'
    products come from one aggregation, scales from another."""
    columns = [c for own in categories.values() for c in own]
    v = [F.col(c).cast("double") for c in columns]
    s = df.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(v) for n, f in (("m", F.avg), ("s", F.stddev))]).first()
    z = [F.coalesce((x - F.lit(float(s[f"m{i}"] or 0.0))) / F.lit(float(s[f"s{i}"] or 1.0)), F.lit(0.0)) for i, x in enumerate(v)]
    at, a = {}, 0
    for name, own in categories.items():
        at[name], a = range(a, a + len(own)), a + len(own)
    products = df.agg(*[F.array(*[F.coalesce(F.covar_pop(z[i], z[j]), F.lit(0.0)) for i in own for j in own if j <= i]).alias(f"p{k}") for k, own in enumerate(at.values())]).first()
    parts = []
    for k, (name, own) in enumerate(at.items()):
        c = square(products[f"p{k}"])
        w = np.linalg.eigh(c)[1][:, -1]
        w = -w if w @ c.sum(1) < 0 else w  # its covariance with the mean of the z-scores
        parts.append(sum((z[i] * F.lit(float(b)) for i, b in zip(own, w, strict=True)), F.lit(0.0)).alias(name))
    raw = df.select(key, *parts)
    ends = raw.agg(*[f(n).alias(f"{x}{i}") for i, n in enumerate(categories) for x, f in (("a", F.min), ("b", F.max))]).first()
    scaled = []
    for i, name in enumerate(categories):
        a, b = ends[f"a{i}"] or 0.0, ends[f"b{i}"] or 0.0
        scaled.append((F.lit(50.0) if b - a <= 1e-12 else 100 * (F.col(name) - F.lit(a)) / F.lit(b - a)).alias(name))
    return raw.select(key, *scaled)


def neighbours(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int | None = None) -> DataFrame:
    """(query, key, distance, place): each query's k nearest rows by Euclidean distance, itself left out."""
    return MetricIndex(rows, key, vector, block=block).nearest(queries, key, vector, k)[0]


def hulls(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, corner, x, y): convex hulls of groups with three points or more, counter-clockwise from the left.

    Points are first thinned to the lowest and highest of each x, which cannot change a hull.
    """
    thin = df.groupBy(by, x).agg(F.min(y).alias("lo"), F.max(y).alias("hi"))

    def hull(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        pts = sorted({(a, b) for a, lo, hi in zip(f[x], f["lo"], f["hi"], strict=True) for b in (lo, hi)})
        out: list[tuple] = []
        for way in (pts, pts[::-1]):
            start = len(out)
            for p in way:
                while len(out) >= start + 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                    out.pop()
                out.append(p)
            out.pop()
        if len(out) < 3:
            out = []
        return pd.DataFrame({by: [key[0]], "all": [[list(map(float, p)) for p in out]]})

    kind = df.schema[by].dataType.simpleString()
    found = thin.groupBy(by).applyInPandas(hull, f"`{by}` {kind}, all array<array<double>>").select(by, F.posexplode("all").alias("corner", "p"))
    return found.select(by, F.col("corner").cast("long").alias("corner"), F.col("p")[0].alias(x), F.col("p")[1].alias(y))
