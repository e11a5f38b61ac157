"""Session and table helpers shared by every module of the package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "gristmill", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; a running session is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables that stand side by side in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
