"""Incremental versions: an event log that comes in small files, deduplicated and counted; battles rated as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.operators import match, rate

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_at_once: int = 1, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def once(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each event once; state older than the watermark is dropped, and events later than it are too."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, by: str) -> DataFrame:
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def run_to_end(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """Goes through what is there in micro-batches and stops; a restart goes on behind the last complete batch."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_to_table(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch into its own folder, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


RESULTS = "judge string, seq long, model_1 string, model_2 string, result string"


def rate_batches(spark: SparkSession, path: str, draw_probability: float = 0.1) -> Callable[[DataFrame, int], None]:
    """A sink that keeps ratings by judge: each batch of results goes on from the ratings of the batch before, in a
    folder of its own, so that a repeated batch writes what it wrote before. Results must come in the order of
    ``seq`` from batch to batch."""

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{path}/batch={number - 1}") if number else spark.createDataFrame([], f"judge string, {rate.RATINGS}")
        rate.continued(before, batch, "judge", draw_probability).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


def latest_ratings(spark: SparkSession, path: str) -> DataFrame:
    """The ratings after the last batch."""
    all_ = spark.read.parquet(path)
    return all_.where(F.col("batch") == all_.agg(F.max("batch")).first()[0]).drop("batch")


def tournament(
    spark: SparkSession, models: DataFrame, judge: str, path: str, play: Callable[[DataFrame], DataFrame], budget: int, batch: int = 16, draw_probability: float = 0.1
) -> DataFrame:
    """Plays until the budget is spent or nothing is pending: choose by information gain, play, append, rate again.

    ``models``: (item, model), who answered what. ``play``: (item, model_a, model_b) to the same with margin_a and
    margin_b. Every round is a folder of battles and one of ratings; a run that was broken off goes on behind the last
    whole round. Gives the ratings (judge, RATINGS).
    """
    names = "item string, model_a string, model_b string, margin_a long, margin_b long, seq long"
    done, ratings, spent, number = spark.createDataFrame([], names), spark.createDataFrame([], f"judge string, {rate.RATINGS}"), 0, 0
    marks = _rounds(spark, f"{path}/rounds")
    if marks:
        number = marks[-1]
        done = spark.read.schema(names).parquet(*[f"{path}/battles/{k}" for k in marks])
        ratings, spent = spark.read.parquet(f"{path}/ratings/{number}"), done.count()
    while spent < budget:
        rated = models.select("model").distinct().join(ratings, "model", "left").select("model", F.coalesce("mu", F.lit(rate.MU)).alias("mu"), F.coalesce("sigma", F.lit(rate.SIGMA)).alias("sigma"))
        a, b = rated.alias("a"), rated.alias("b")
        gains = a.join(b, F.col("a.model") < F.col("b.model")).select(F.col("a.model").alias("model_1"), F.col("b.model").alias("model_2"), match.gain(F.col("a.mu"), F.col("a.sigma"), F.col("b.mu"), F.col("b.sigma")).alias("gain"))
        open_ = match.pending(models.select("item").distinct(), models, done)
        chosen = match.selected(open_, gains, min(batch, budget - spent), number)
        order = F.md5(F.concat_ws(":", "item", "model_a", "model_b"))
        number += 1
        seq = F.lit(number * 1_000_000).cast("long") + F.pmod(F.xxhash64(order), F.lit(1_000_000))
        play(chosen.select("item", "model_a", "model_b")).withColumn("seq", seq).select(*[n.split()[0] for n in names.split(", ")]).write.mode("overwrite").parquet(f"{path}/battles/{number}")
        fresh = spark.read.schema(names).parquet(f"{path}/battles/{number}")
        n = fresh.count()
        if not n:
            break
        done = done.unionByName(fresh)
        paired = rate.paired_results(done).select(F.lit(judge).alias("judge"), "seq", "model_1", "model_2", "result")
        rate.skill_ratings(paired, "judge", draw_probability).write.mode("overwrite").parquet(f"{path}/ratings/{number}")
        ratings, spent = spark.read.parquet(f"{path}/ratings/{number}"), spent + n
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("overwrite").parquet(f"{path}/rounds/{number}")
    return ratings


def _rounds(spark: SparkSession, path: str) -> list[int]:
    try:
        return sorted(r["number"] for r in spark.read.schema("number long").parquet(f"{path}/*").collect())  # a row a round
    except AnalysisException:
        return []
