"""Writing results: dated and rounded CSV, atomic tables, runs with their settings, guarded reuse of what was computed."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "number long, name string"


def write_scores(df: DataFrame, path: str, date: str, order: str) -> str:
    """CSV by falling score, nulls last, numbers with four digits, in a folder that bears the date."""
    shown = [F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    out = f"{path}_{date}"
    df.orderBy(F.desc_nulls_last(order)).select(*shown).write.mode("overwrite").option("header", True).csv(out)
    return out


def write_latin(df: DataFrame, path: str) -> None:
    """One CSV file in ISO-8859-1 whose lines end with a carriage return and a line feed."""
    df.coalesce(1).write.mode("overwrite").options(header=True, encoding="ISO-8859-1", lineSep="\r\n", escape='"').csv(path)


def committed(spark: SparkSession, path: str) -> list:
    """The finished versions of an atomic table, in order."""
    try:
        return sorted(spark.read.schema(COMMITS).json(f"{path}/commits/*").collect(), key=lambda r: r["number"])  # a row a write
    except AnalysisException:
        return []


def write_atomic(df: DataFrame, path: str) -> int:
    """A new version of a table: its data first, its commit last. Readers see the version before until then, and a
    write that breaks off leaves no trace. One writer at a time."""
    spark = df.sparkSession
    done = committed(spark, path)
    number = done[-1]["number"] + 1 if done else 1
    name = f"{number:06d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/data/{name}")
    spark.createDataFrame([(number, name)], COMMITS).coalesce(1).write.json(f"{path}/commits/{name}")
    return number


def read_atomic(spark: SparkSession, path: str) -> DataFrame:
    done = committed(spark, path)
    if not done:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/data/{done[-1]['name']}")


def append_rows(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Rows added to a CSV table under a header that never changes: other columns go, missing ones are empty. Each
    write is files of its own, so that no line can be left without its end."""
    own = df.select(*[(F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])
    own.write.mode("append").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def with_labels(df: DataFrame, fixed: Sequence[str], prefix: str = "label_") -> DataFrame:
    """The fixed columns in their order, then the dynamic ones with that prefix, sorted."""
    return df.select(*[F.col(f"`{c}`") for c in [*fixed, *sorted(c for c in df.columns if c.startswith(prefix) and c not in fixed)]])


def write_run(tables: Mapping[str, DataFrame], settings: Mapping, path: str, name: str) -> str:
    """A run's folder: each table as CSV, the settings as JSON, written last to say that the run is whole."""
    out = f"{path}/{name}"
    for table, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{out}/{table}")
    spark = next(iter(tables.values())).sparkSession
    text = json.dumps({"tables": sorted(tables), "settings": dict(settings)}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/metadata")
    return out


def read_run(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """The settings and tables of a whole run; an error for one that is not."""
    said = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    return said["settings"], {t: spark.read.option("header", True).csv(f"{path}/{t}") for t in said["tables"]}


def saved_splits(keys: DataFrame, key: str, path: str, n_splits: int, repeats: int, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, repeat, fold) of cross-validation. Saved splits are used again only if they were made for as many rows,
    folds and repeats; else they are made and saved anew."""
    spark, n = keys.sparkSession, keys.count()
    try:
        old = read_atomic(spark, path)
        fits = old.agg(F.count_distinct(key).alias("n"), F.count_distinct("fold").alias("k"), F.count_distinct("repeat").alias("r")).first()
        if (fits["n"], fits["k"], fits["r"]) == (n, n_splits, repeats):
            return old
    except FileNotFoundError:
        pass
    write_atomic(make(keys), path)
    return read_atomic(spark, path)


def copy_newer(spark: SparkSession, sources: Mapping[str, str], path: str) -> list[str]:
    """Copies tables (name -> CSV folder) to a central store where the source changed after the last copy; the names
    of those that were copied. Times and names are kept in the store's own table."""
    state = {r["name"]: r["time"] for r in (read_atomic(spark, f"{path}/_state").collect() if committed(spark, f"{path}/_state") else [])}
    fresh = []
    for name, source in sources.items():
        time = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(source).agg(F.max("modificationTime")).first()[0]
        if time is not None and (name not in state or time > state[name]):
            write_atomic(spark.read.option("header", True).csv(source), f"{path}/{name}")
            state[name] = time
            fresh.append(name)
    if fresh:
        write_atomic(spark.createDataFrame(sorted(state.items()), "name string, time timestamp"), f"{path}/_state")
    return fresh


def content_mark(df: DataFrame) -> list:
    """Count, sum and another sum of row hashes: equal marks for equal rows in any order, repeats counted."""
    columns = ", ".join(f"`{c}`" for c in df.columns)
    h = lambda salt: F.sum(F.expr(f"cast(xxhash64({salt}{columns}) as decimal(38, 0))"))
    return [str(x) for x in df.agg(F.count("*"), h(""), h("17, ")).first()]


def file_mark(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files' bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def cached(spark: SparkSession, root: str, settings: dict, source: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A result under a folder named by settings and content; made once, read from then on."""
    mark = [settings, source.columns, content_mark(source)]
    path = f"{root}/{hashlib.sha256(json.dumps(mark, sort_keys=True).encode()).hexdigest()[:24]}"
    if not committed(spark, path):
        write_atomic(make(source), path)
    return read_atomic(spark, path)
