"""What the corpus operators share: shared-folder tables, column guards and small text helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Folders of local applications that have no spark.checkpoint.dir, which cannot be set once a session runs.
OWN_FOLDERS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where that is unset, a folder of this machine serves a
    session that has no other machines; any other session is told to set it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    here = spark.sparkContext.applicationId
    if here not in OWN_FOLDERS:
        OWN_FOLDERS[here] = "file://" + tempfile.mkdtemp(prefix="gristmill-")
    return OWN_FOLDERS[here]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: For rows of megabytes: Parquet's writer looks at its buffers after each row and not after a hundred, so that a task
#: holds some megabytes (or one row) when it writes and when it reads again.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def stored(df: DataFrame, name: str, codec: str | None = None, large_rows: bool = False) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: its lineage ends there, so lost
    executors cost no recomputation beyond that table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes the tables of frames that ``stored`` gave: nothing that is still to run may read them."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bitmap(hashes: DataFrame, bits: int) -> bytes:
    """2 ** bits bits, of which those that the low bits of the column ``hash`` name are set."""
    at = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = hashes.select(F.shiftright(at, 6).alias("w"), one.alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out.tobytes()


def looked_up(rows: DataFrame, side: DataFrame, keys: list[str], hot: int = 1000) -> DataFrame:
    """The rows with the other columns of ``side``, which has one row for each key; rows without a match go. A key that
    more than one row in ``hot`` has would fill one task: such keys, ``hot`` at most, are sent to all tasks."""
    rows = stored(rows, "asked")
    n = rows.count()
    many = rows.groupBy(*keys).count().where(F.col("count") * hot > n).select(*keys, F.lit(True).alias("__hot"))
    many = stored(side.join(F.broadcast(many), keys, "left").select(side["*"], F.coalesce("__hot", F.lit(False)).alias("__hot")), "answers")
    wanted, others = many.where("__hot").drop("__hot"), many.where("not __hot").drop("__hot")
    marks = F.broadcast(wanted.select(*keys))
    return rows.join(F.broadcast(wanted), keys).unionByName(rows.join(marks, keys, "left_anti").join(others, keys))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def crc_of_id(c: Column) -> Column:
    """crc32 of the id as text."""
    return F.crc32(c.cast("string").cast("binary"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches that fit in memory several times over, however long the texts are."""
    for key, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns: whatever else a table carries cannot clash with what an operator adds. What an operator
    hands to Python starts here, and goes there in small batches."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{n}`") for n in names])


def as_came(df: DataFrame) -> list[Column]:
    """The frame's columns, whatever characters their names have."""
    return [F.col(f"`{c}`") for c in df.columns]


def mapped(df: DataFrame, run: Callable, added: str) -> DataFrame:
    """mapInPandas that keeps all columns of ``df`` and appends ``added``, whatever the columns are called."""
    small_batches(df.sparkSession)
    safe, seen = [], set()
    for k, name in enumerate(df.columns):
        safe.append(name if name.isidentifier() and name not in seen else f"column_{k}__")
        seen.add(name)
    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(safe, df.schema, strict=True))
    out = df.toDF(*safe).mapInPandas(run, f"{schema}, {added}")
    return out.toDF(*df.columns, *out.columns[len(safe) :])
