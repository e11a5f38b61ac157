"""Connected components by alternating large-star and small-star steps; edges never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long) but the roots; the root is the smallest node.

    Self-loops, repeated and reversed edges are fine. Each round is a written table, so that a lost executor
    costs one round at most; the number of rounds grows with the logarithm of the longest path.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo")
        last, now = now, stored(small.where("hi != lo").distinct(), "edges")
        discard(last)
        before, seen = seen, mark(now)
        if before == seen:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def mark(edges: DataFrame) -> tuple[int, int]:
    """Count and checksum: equal marks, equal sets of edges."""
    r = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(hi, lo))").alias("x")).first()
    return r["n"], r["x"] or 0
