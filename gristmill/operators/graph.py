"""Walks over edge tables, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def depths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth) of all nodes that the roots reach over (src, dst): a join of the frontier for each level.

    Levels are kept only while the walk goes on; each is a table of (node, depth) whose lineage is cut by a checkpoint
    where the session has a folder for it.
    """
    spark = edges.sparkSession
    keep = (lambda df: df.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda df: df.cache())
    e = edges.select("src", "dst").cache()
    seen = keep(roots.select("node", F.lit(0).alias("depth")).distinct())
    frontier, depth = seen, 0
    while True:
        depth += 1
        next_ = frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = keep(next_.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            e.unpersist()
            return seen
        seen = keep(seen.unionByName(frontier))
