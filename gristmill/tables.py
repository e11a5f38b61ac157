"""Frames that a loop goes over again and again, written to the shared folder instead of computed anew."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local applications without spark.checkpoint.dir, which cannot be set once a session runs.
OWN_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors share. A local session without it gets a folder of its
    own; any other is told to set it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    here = spark.sparkContext.applicationId
    if here not in OWN_FOLDERS:
        OWN_FOLDERS[here] = "file://" + tempfile.mkdtemp(prefix="gristmill-")
    return OWN_FOLDERS[here]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table: what is read again costs no more than that table, executors lost or not."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes the tables of frames that ``stored`` gave; nothing that is still to run may read them."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
