"""Typing, filtering and profiling of wide tables whose columns are not known beforehand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.exact import finite, medians


def number(text: Column) -> Column:
    """A number out of text with percent, currency and thousands signs; null if it is none."""
    return F.regexp_replace(F.trim(text), r"[%$,±\s]", "").try_cast("double")


def typed(df: DataFrame, columns: Sequence[str], order: str, sample: int = 10) -> DataFrame:
    """Text columns turned to numbers where their first values look like it.

    A column with a link among its first ``sample`` values stays. With a percent sign among them the whole column
    is cast or, if one value cannot be, none of it; other columns are cast value by value, with nulls for the rest.
    Few rows of samples and one of counts come to the driver, whatever the table's size.
    """
    stripped = lambda c: F.regexp_replace(F.trim(c), "%", "").try_cast("double")
    rows = {c: [r[c] for r in df.where(F.col(c).isNotNull()).orderBy(order).select(c).limit(sample).collect()] for c in columns}
    checks = df.agg(*[(F.count(c) == F.count(stripped(F.col(c)))).alias(c) for c in columns]).first()
    out = df
    for c in columns:
        if not rows[c] or any("http" in v for v in rows[c]):
            continue
        if any("%" in v for v in rows[c]):
            out = out.withColumn(c, stripped(F.col(c))) if checks[c] else out
        else:
            out = out.withColumn(c, F.col(c).try_cast("double"))
    return out


def long_form(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column, value) with a row for each cell."""
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("cell")).select(key, "cell.*")


def profile(cells: DataFrame) -> DataFrame:
    """A row for each column of a long form: counts, spread, bounds, share of the commonest value."""
    by_value = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    whole = F.abs(F.col("value") - F.round("value")) <= 1e-6
    return by_value.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("n_values"),
        F.count("value").alias("n_distinct"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("n_commonest"),
        F.min(F.when(F.col("value").isNotNull(), whole)).alias("whole_numbers"),
    )


def filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinities and nulls become the column's median, or 0 if it has none."""
    middle = medians(df, columns)
    return df.select(*[F.coalesce(finite(c), F.lit(middle[c]), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def one_space(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s+", " ")


def truth(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "1", "yes")


def json_part(text: Column) -> Column:
    """From the first brace to the last, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def verdicts(df: DataFrame, by: str, ranges: dict[str, tuple[float | None, float | None]], least: int, most_issues: int) -> DataFrame:
    """(by, n, issues, valid): values out of their range (null is), counted over all columns of a source's rows."""
    issues = F.lit(0).cast("long")
    for c, (low, high) in ranges.items():
        v = F.col(c)
        fine = v.isNotNull() & (F.lit(True) if low is None else v >= low) & (F.lit(True) if high is None else v <= high)
        issues = issues + F.count_if(~fine)
    g = df.groupBy(by).agg(F.count("*").alias("n"), issues.alias("issues"))
    return g.withColumn("valid", (F.col("n") >= least) & (F.col("issues") <= most_issues))
