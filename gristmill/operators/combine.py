"""Joining many sources by entity name: keep-first dedup, name maps, wide full outer joins, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a stated order; ``order`` should be total, so that the choice is stable.

    ``min_by`` over a struct keeps the work in a map-side combined aggregation, where a window would sort whole groups.
    """
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("__row")).select(*key, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def mapped_names(df: DataFrame, name: str, mapping: DataFrame, out: str) -> DataFrame:
    """``out``: the mapped name, or the name itself where the map has none or an empty one; trimmed.

    ``mapping`` has the columns ``source_name`` and ``canonical`` and one row for each name.
    """
    joined = df.join(mapping, F.trim(F.col(name)) == F.col("source_name"), "left")
    return joined.withColumn(out, F.trim(F.coalesce(F.nullif(F.col("canonical"), F.lit("")), F.col(name)))).drop("source_name", "canonical")


def prefixed(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != key])


def combine(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """All sources side by side, a row for each key of any of them.

    Sources are unique by key, so that a union with one aggregation gives what a chain of full outer joins would,
    with a single shuffle however many sources there are. ``in_<source>`` tells where a key is present.
    """
    parts = [prefixed(df, name, key).withColumn(f"in_{name}", F.lit(True)) for name, df in sources.items()]
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    flags = {f"in_{name}" for name in sources}
    values = [F.coalesce(F.max(c), F.lit(False)).alias(c) if c in flags else F.first(c, ignorenulls=True).alias(c) for c in wide.columns if c != key]
    return wide.groupBy(key).agg(*values)


def missing_share(columns: Sequence[str]) -> Column:
    """Share of null cells in a row."""
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) / F.lit(float(len(columns)))


def conflicts(df: DataFrame, key: str) -> DataFrame:
    """Keys with several rows: their number, the columns in which they differ and the least and greatest values."""
    rest = [c for c in df.columns if c != key]
    differ = F.array_compact(F.array(*[F.when(F.count_distinct(c) > 1, F.lit(c)) for c in rest]))
    return df.groupBy(key).agg(F.count("*").alias("n_rows"), differ.alias("columns")).where("n_rows > 1")


def overridden(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Cells of ``base``, replaced by those cells of ``other`` that are not null."""
    shared = [c for c in base.columns if c in other.columns and c != key]
    right = other.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in shared])
    return base.join(right, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in shared else F.col(c) for c in base.columns])


def frontier(df: DataFrame, cost: str, score: str, ranges: int = 64) -> DataFrame:
    """Rows that no other row dominates (no dearer, no worse, and better in one).

    A running maximum over cheaper rows replaces the self-join. Costs fall into ranges by approximate percentiles;
    the best score of each earlier range (at most ``ranges`` rows) comes in before the window within the range.
    """
    best = df.where(F.col(cost).isNotNull() & F.col(score).isNotNull()).groupBy(cost).agg(F.max(score).alias("__best"))
    edges = best.agg(F.percentile_approx(cost, [k / ranges for k in range(1, ranges)], 1000).alias("e")).first()["e"] or []
    place = sum((F.when(F.col(cost) > F.lit(e), 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    ranged = best.withColumn("__range", place)
    tops = ranged.groupBy("__range").agg(F.max("__best").alias("top"))
    earlier = tops.withColumn("__earlier", F.max("top").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    inside = F.max("__best").over(Window.partitionBy("__range").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    seen = F.greatest(F.col("__inside"), F.col("__earlier"))
    front = ranged.withColumn("__inside", inside).join(F.broadcast(earlier), "__range").where(seen.isNull() | (F.col("__best") > seen))
    return df.join(front.select(cost, F.col("__best").alias(score)), [cost, score], "left_semi")


def by_name(roster: DataFrame, name: str, wanted: list[str]) -> DataFrame:
    """The roster's rows whose trimmed name is one of the wanted, with ``place``, the name's place among those. A wanted
    name (trimmed too) that the roster lacks is an error that says which; of a name's rows all are there."""
    order: dict[str, int] = {}
    for k, w in enumerate(wanted):
        order.setdefault(w.strip(), k + 1)
    own = roster.withColumn("__name", F.trim(F.col(name))).where(F.col("__name").isin(list(order)))
    there = {r[0] for r in own.select("__name").distinct().collect()}  # no more than are wanted
    if missing := [w for w in order if w not in there]:
        raise ValueError(f"not on the roster: {', '.join(missing)}")
    places = F.create_map(*[F.lit(x) for pair in order.items() for x in pair]) if order else F.lit(None)
    return own.withColumn("place", places[F.col("__name")].cast("long") if order else F.lit(None).cast("long")).drop("__name")
