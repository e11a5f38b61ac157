"""Aggregates over runs, questions, judges and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Columns on a scale of 0 to 100 between the least and greatest of their group; constant ones become 0.

    Bounds come from a map-side combined aggregation and are joined back; no group is collected in one task.
    """
    bounds = [f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    if by:
        joined = df.join(df.groupBy(*by).agg(*bounds), list(by))
    else:
        joined = df.join(F.broadcast(df.agg(*bounds)))  # one row
    scale = lambda c: F.when(F.col(f"__hi_{c}") > F.col(f"__lo_{c}"), 100 * (F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))).otherwise(0.0)
    return joined.select(*[F.when(F.col(c).isNotNull(), scale(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def accuracy(correct: Column, partial: Column, total: Column) -> Column:
    """Full marks for correct answers, half for partial ones."""
    return (correct + 0.5 * partial) / total


def mean(value: str) -> Column:
    """The mean as an aggregate whose sum is exact, so that it is the same in whatever order the rows come: decimals of
    up to 14 digits after the point and below 10^14. Other numbers are summed up as doubles."""
    exact = F.col(value).try_cast("decimal(28,14)")
    as_told = F.count(value) == F.count_if(exact.cast("double") == F.col(value))
    return F.when(as_told, F.try_divide(F.sum(exact).cast("double"), F.count(value))).otherwise(F.avg(value))


def mean_in_order(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """(by, value): the mean of each group, summed up as doubles in the order of ``order``, which is what one thread
    gives that reads the rows so. A bound right at a mean then parts the same groups. Running sums hold no group whole."""
    rows = Window.partitionBy(*by).orderBy(order, value)
    running = df.select(*by, value, F.sum(value).over(rows.rowsBetween(Window.unboundedPreceding, 0)).alias("__sum"), F.row_number().over(rows).alias("__place"))
    return running.groupBy(*by).agg(F.try_divide(F.max_by("__sum", "__place"), F.count(value)).alias(value))


def in_order(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """(by, name): the few values of each group in rising order, whose sums then do not depend on that of the rows."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias(name))


def moments(values: Column) -> tuple[Column, Column]:
    """Mean and sample deviation of an array, summed up in its order; null where there are too few values."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    n = F.size(values)
    m = F.try_divide(total(values), n)
    return m, F.when(n > 1, F.sqrt(total(F.transform(values, lambda v: (v - m) * (v - m))) / (n - 1)))


def interval(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, deviation, count, standard error and 95 % interval of each group."""
    g = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev(value).alias("sd"), F.count(value).alias("n"))
    se = F.col("sd") / F.sqrt("n")
    return g.select(*by, "n", F.round("mean", 4).alias("mean"), F.round(se, 5).alias("se"), F.round(F.col("mean") - 1.96 * se, 4).alias("low"), F.round(F.col("mean") + 1.96 * se, 4).alias("high"))


def errors(actual: Column, predicted: Column) -> list[Column]:
    """RMSE, MAE, R2 and Pearson's r as aggregates."""
    e = actual - predicted
    return [
        F.round(F.sqrt(F.avg(e * e)), 5).alias("rmse"),
        F.round(F.avg(F.abs(e)), 5).alias("mae"),
        F.round(1 - F.sum(e * e) / (F.var_pop(actual) * F.count(actual)), 6).alias("r2"),
        F.round(F.corr(actual, predicted), 6).alias("pearson"),
    ]


def alpha(df: DataFrame, row: str, judge: str, value: str) -> DataFrame:
    """Cronbach's alpha of judges over rows that all of them scored: k, n and alpha in one row."""
    k = df.select(judge).distinct().count()
    full = df.groupBy(row).agg(F.count_distinct(judge).alias("k"), F.sum(value).alias("total")).where(F.col("k") == k)
    own = df.join(full.select(row), row, "left_semi").groupBy(judge).agg(F.variance(value).alias("v")).agg(F.sum("v").alias("parts"))
    whole = full.agg(F.variance("total").alias("whole"), F.count("*").alias("n"))
    return own.join(F.broadcast(whole)).select(F.lit(k).cast("long").alias("k"), "n", F.round(k / (k - 1) * (1 - F.col("parts") / F.col("whole")), 5).alias("alpha"))
