"""Ranks, percentiles and running values that do not gather a whole table, group or tie in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(df: DataFrame, column: str, ranges: int) -> list[float]:
    """Bounds that part the rows about evenly; a value that repeats among them is a heavy one."""
    return df.agg(F.percentile_approx(column, [k / ranges for k in range(1, ranges)], 2000).alias("e")).first()["e"] or []


def range_of(value: Column, bounds: Sequence[float]) -> Column:
    """How many bounds lie below the value; -1 for null."""
    if not bounds:
        return F.when(value.isNotNull(), 0).otherwise(-1)
    n = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: value > b))
    return F.when(value.isNotNull(), n).otherwise(-1)


def ranked(df: DataFrame, order: list[Column], name: str, buckets: int = 64, on: str | None = None, by: Sequence[str] = (), then: str | None = None) -> DataFrame:
    """1-based row numbers over a whole table, or over groups of it, in the order of ``on`` (descending, nulls last),
    then ``order``, whose first column may be named in ``then`` if it is a number in rising order.

    A window over the table would sort it in one task. Here rows fall into ranges by approximate percentiles of
    ``on``; the rows of a value that is heavy enough to fill ranges alone fall into ranges of ``then``. Rows are
    numbered within their range, and the counts of the ranges before are added.
    """
    bounds = edges(df, on, buckets)
    heavy = sorted({b for b in bounds if bounds.count(b) > 1})
    sub = F.lit(buckets)
    if heavy and then:
        sub = F.when(F.col(on).isin(heavy), range_of(F.col(then), edges(df, then, buckets))).otherwise(sub)
    placed = df.withColumn("__range", range_of(F.col(on), bounds)).withColumn("__sub", sub)
    counts = placed.groupBy(*by, "__range", "__sub").agg(F.count("*").alias("n"))  # buckets * (buckets + 1) rows a group at most
    before = F.sum("n").over(Window.partitionBy(*by).orderBy(F.desc("__range"), "__sub").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy(*by, "__range", "__sub").orderBy(F.desc_nulls_last(on), *order))
    return placed.join(first, [*by, "__range", "__sub"]).withColumn(name, (inside + F.col("__before")).cast("long")).drop("__range", "__sub", "__before")


def below(values: DataFrame, value: str, n: str, by: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """``values`` (one row for each distinct value of a group, with its count ``n``) and ``before``, the count of
    smaller values of the group: running sums within ranges, on top of those of the ranges before."""
    placed = values.withColumn("__range", range_of(F.col(value), edges(values, value, buckets)))
    sums = placed.groupBy(*by, "__range").agg(F.sum(n).alias("s"))
    before = F.sum("s").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    first = sums.withColumn("__first", F.coalesce(before, F.lit(0))).drop("s")
    inside = F.sum(n).over(Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return placed.join(first, [*by, "__range"]).withColumn("before", F.coalesce(inside, F.lit(0)) + F.col("__first")).drop("__range", "__first")


def shares_below(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """(by, column, n, before): each distinct value of a group with its rows and those of smaller values."""
    return below(df.groupBy(*by, column).agg(F.count("*").alias("n")), column, "n", by)


def average_ranks(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Ranks with ties at their mean, within groups: from counts of distinct values, so that no group is sorted whole."""
    out = df
    for c in columns:
        rank = (F.col("before") + (F.col("n") + 1) / 2).cast("double")
        own = shares_below(df, c, by).select(*[F.col(b).alias(f"__{b}") for b in by], F.col(c).alias("__value"), rank.alias(f"rank_{c}"))
        met = F.col(c).eqNullSafe(F.col("__value"))
        for b in by:
            met = met & F.col(b).eqNullSafe(F.col(f"__{b}"))
        out = out.join(own, met).drop("__value", *[f"__{b}" for b in by])
    return out
