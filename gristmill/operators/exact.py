"""Exact percentiles of columns of any size: ranges are counted and narrowed, no column is gathered anywhere."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.tables import discard, stored

#: Ranges that are counted at once; each pass narrows a percentile's range that many times, or to one value.
RANGES = 1024


def finite(c: str) -> Column:
    """The column as double, null where it is no finite number."""
    v = F.col(f"`{c}`").cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def placed(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of RANGES equal ranges from a to b (a < b) each value lies in. Halves keep the width of any two doubles
    finite, and ranges too narrow for doubles fall into the last one, whose bounds are then values themselves."""
    width = b / 2 - a / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        share = np.nan_to_num((v / 2 - a / 2) / width * RANGES)
    place = np.clip(np.floor(share), 1, RANGES - 1).astype(np.int64)
    place[width < 1e-300] = RANGES - 1  # subnormal: parted by the bounds alone
    return np.where(v == a, 0, place)


def counted(own: DataFrame, spans: Sequence[tuple[str, float, float]]) -> DataFrame:
    """(i, place, n, a, b): rows, least and greatest value of each range of each span that has any. A column's spans
    are apart from each other. A task gives each of its ranges once."""
    of = {c: [i for i, (d, _, _) in enumerate(spans) if d == c] for c in {c for c, _, _ in spans}}  # in rising order
    low, high = np.array([a for _, a, _ in spans]), np.array([b for _, _, b in spans])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(spans) * RANGES, np.int64)
        least, most = np.full(len(n), np.inf), np.full(len(n), -np.inf)
        for f in frames:
            for c, which in of.items():
                v = f[c].to_numpy(np.float64)
                v = v[~np.isnan(v)] + 0.0
                i = np.array(which)[np.maximum(np.searchsorted(low[which], v, "right") - 1, 0)]
                in_ = (v >= low[i]) & (v <= high[i])
                v, i = v[in_], i[in_]
                at = i * RANGES + placed(v, low[i], high[i])
                np.add.at(n, at, 1)
                np.minimum.at(least, at, v)
                np.maximum.at(most, at, v)
        there = np.flatnonzero(n)
        yield pd.DataFrame({"i": there // RANGES, "place": there % RANGES, "n": n[there], "a": least[there], "b": most[there]})

    each = own.select(*of).mapInPandas(run, "i long, place long, n long, a double, b double")
    return each.groupBy("i", "place").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))


def quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """For each column the values at these shares, interpolated between neighbours; None for columns without numbers.

    The columns are stored once. A pass counts the values in ranges between the bounds known so far (RANGES rows for
    each open percentile come to the driver) and goes on inside the range that holds the rank, between the least and
    the greatest value there. The least value has a range of its own, so that every pass leaves out one value at
    least, whatever the values are; ties end a range at once.
    """
    if not wanted:
        return {}
    names = {c: f"v{i}" for i, c in enumerate(wanted)}
    own = stored(df.select(*[finite(c).alias(n) for c, n in names.items()]), "quantile-columns")
    v = {c: F.col(n) for c, n in names.items()}
    row = own.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(v.values()) for n, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    open_: dict[tuple[str, int], tuple[float, float, int]] = {}
    found: dict[tuple[str, int], float] = {}
    size = {c: row[f"n{i}"] for i, c in enumerate(v)}
    for i, c in enumerate(v):
        for p in wanted[c] if size[c] else ():
            for k in {math.floor(p * (size[c] - 1)), math.ceil(p * (size[c] - 1))}:
                open_[c, k] = (row[f"a{i}"], row[f"b{i}"], 0)
    while open_ := {t: s for t, s in open_.items() if s[0] != s[1] or found.update({t: s[0]})}:
        spans = sorted({(names[c], a, b) for (c, _), (a, b, _) in open_.items()})
        counts = counted(own, spans).collect()
        rows: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r["i"], r["place"])):
            rows.setdefault(r["i"], []).append(r)
        at = {s: i for i, s in enumerate(spans)}
        for t, (a, b, below) in open_.items():
            for r in rows[at[names[t[0]], a, b]]:
                if t[1] < below + r["n"]:
                    open_[t] = (r["a"], r["b"], below)
                    break
                below += r["n"]
    discard(own)
    out: dict[str, list[float | None]] = {}
    for c, shares in wanted.items():
        at = [p * (size[c] - 1) for p in shares]
        out[c] = [between(found[c, math.floor(x)], found[c, math.ceil(x)], x - math.floor(x)) if size[c] else None for x in at]
    return out


def between(a: float, b: float, share: float) -> float:
    """The place at that share of the way from a to b, also where b - a is beyond the greatest double."""
    return a + (b - a) * share if math.isfinite(b - a) else a * (1 - share) + b * share


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in quantiles(df, {c: [0.5] for c in columns}).items()}
