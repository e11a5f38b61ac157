"""Ranks of rows in many draws around their values, without a sorted copy of the table for each draw.

A draw is arithmetic on the key, computed where the row is. Draws fall into ranges of values; a first pass counts the
draws of each range, a second sends a row's draws of a range together, a block of draws at a time, so that a task
numbers a bounded number of them and adds the counts of the ranges above.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.latent import summed
from gristmill.operators.rank import edges
from gristmill.tables import stored

#: Rows of a range, about; draws of a block; rows whose draws are held at once.
RANGE, BLOCK, CHUNK = 8192, 125, 256
#: Keys and draws are mixed modulo these; numbers from 0 to 1 come from the remainders.
U, V = (7919, 104729, 10007), (15485863, 32452843, 20011)


def tables(width: float) -> tuple[np.ndarray, np.ndarray]:
    """What a draw's two remainders (negative ones too, which have no logarithm) come to: width * radius, and cosine."""
    share = lambda n: [(r + 0.5) / n for r in range(1 - n, n)]
    return np.array([width * math.sqrt(-2 * math.log(u)) if u > 0 else math.nan for u in share(U[2])]), np.array([math.cos(2 * math.pi * v) for v in share(V[2])])


def draws(keys: np.ndarray, values: np.ndarray, n: int, radius: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """A row each, a draw each: nan where there is none."""
    k = np.arange(n)
    at = [np.fmod(keys[:, None] * a + k * b, m) + m - 1 for a, b, m in (U, V)]
    return values[:, None] + radius[at[0]] * cosine[at[1]]


def ranks(df: DataFrame, key: str, value: str, n: int, width: float) -> DataFrame:
    """(key, ranks): the places of each key's rows in all draws, in rising order. The greatest draw is first, equal ones
    go by key, missing ones come last."""
    spark = df.sparkSession
    v = F.col(value).cast("double")
    v = F.when(F.isnan(v), float("inf")).when(v == float("inf"), sys.float_info.max).otherwise(v)  # nan is the greatest, and no gap
    own = stored(df.select(F.col(key).cast("long").alias("key"), v.alias("value")).repartition(max(8, spark.sparkContext.defaultParallelism)), "drawn-rows")
    size, none = own.agg(F.count("*"), F.count_if(F.col("key").isNull())).first()
    bounds = np.array(sorted(set(edges(own, "value", min(2000, size // RANGE)))) if size >= 2 * RANGE else [], np.float64)
    held, parts = tables(width), len(bounds) + 2

    def place(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Draws, and their ranges from the lowest: 0 for those that are missing."""
        x = draws(f["key"].to_numpy(), f["value"].to_numpy(np.float64), n, *held)
        return x, np.where(np.isnan(x), 0, 1 + np.searchsorted(bounds, x, "left"))

    def count(f: pd.DataFrame) -> np.ndarray:
        out = np.zeros(parts * n)
        for a in range(0, len(f), CHUNK):
            out += np.bincount((place(f[a : a + CHUNK])[1] * n + np.arange(n)).ravel(), minlength=parts * n)
        return out

    known = own.where("key is not null")
    counts = summed(known, ["key", "value"], count, parts * n).reshape(parts, n)  # a number for each range and draw
    above = (counts[::-1].cumsum(0)[::-1] - counts).astype(np.int64)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for a in range(0, len(whole), CHUNK):
                f = whole[a : a + CHUNK]
                x, at = place(f)
                keys, out = f["key"].to_numpy(), []
                for b in range(0, n, BLOCK):
                    group = at[:, b : b + BLOCK]
                    order = np.argsort(group, axis=1, kind="stable")
                    part = np.take_along_axis(group, order, 1)
                    v = np.take_along_axis(x[:, b : b + BLOCK], order, 1)
                    first = np.c_[np.ones(len(f), bool), part[:, 1:] != part[:, :-1]].ravel()
                    start = np.flatnonzero(first)
                    end = np.append(start[1:], part.size)
                    which, v, row = (order + b).astype(np.uint32).ravel(), v.ravel(), start // part.shape[1]
                    out.append(pd.DataFrame({"part": part.ravel()[start], "block": b // BLOCK, "key": keys[row], "draws": [which[i:j].tobytes() for i, j in zip(start, end, strict=True)], "values": [v[i:j].tobytes() for i, j in zip(start, end, strict=True)]}))
                yield pd.concat(out)

    def number(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("key", kind="stable")
        which, v = np.frombuffer(b"".join(f["draws"]), np.uint32).astype(np.int64), np.frombuffer(b"".join(f["values"]), np.float64)
        lengths = (f["draws"].str.len() // 4).to_numpy()
        order = np.lexsort((-v, which))  # stable: equal ones stay by key
        sorted_ = which[order]
        rank = np.empty(len(v), np.int64)
        rank[order] = np.arange(len(v)) - np.searchsorted(sorted_, np.arange(n))[sorted_] + 1 + above[f["part"].iloc[0]][sorted_]
        ends = np.cumsum(lengths)
        return pd.DataFrame({"key": f["key"].to_numpy(), "ranks": [rank[e - k : e] for e, k in zip(ends, lengths, strict=True)]})

    sent = known.mapInPandas(send, "part int, block int, key long, draws binary, values binary")
    told = sent.groupBy("part", "block").applyInPandas(number, "key long, ranks array<long>")
    out = told.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("ranks"))).alias("ranks"))
    if none:  # rows without a key have no draws, and are the last of all
        last = F.sequence(F.lit(size - none + 1).cast("long"), F.lit(size).cast("long"))
        out = out.unionByName(spark.range(1).select(F.lit(None).cast("long").alias("key"), F.flatten(F.transform(last, lambda r: F.array_repeat(r, n))).alias("ranks")))
    return out.select(F.col("key").cast(df.schema[key].dataType).alias(key), "ranks")


def percentile(numbers: str, p: float) -> Column:
    """Of an array in rising order, interpolated as Spark's percentile does."""
    at = (F.size(numbers) - 1) * F.lit(p)
    low, high = F.floor(at), F.ceil(at)
    of = lambda i: F.get(F.col(numbers), i.cast("int")).cast("double")
    return F.when(low == high, of(low)).otherwise((high - at) * of(low) + (at - low) * of(high))
