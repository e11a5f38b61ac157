"""Queries on probes: what vectors tell of battles and of win rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import probe
from gristmill.plans.battles import battles
from gristmill.registering import Queries
from gristmill.session import table
from gristmill.tables import stored

queries = Queries()
DIMS, FOLDS, LEAST = 16, 4, 5


def model_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Mean vectors of the models (a model's texts are those of its label), by their first dimensions."""
    e = table(spark, d, "embeddings").select(F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"), F.posexplode("embedding").alias("i", "v")).where(F.col("i") < DIMS)
    means = e.groupBy("model", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy("model").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("x"))


def battle_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(seq, x, y, fold): winner minus loser (y 1) or turned round (y 0) by a hash of the battle; battles of one pair of
    models stand in one fold."""
    v = model_vectors(spark, d)
    side = lambda who, name: v.select(F.col("model").alias(who), F.col("x").alias(name))
    own = battles(spark, d).join(side("winner", "xw"), "winner").join(side("loser", "xl"), "loser")
    turned = F.conv(F.substring(F.md5(F.col("seq").cast("string")), 1, 1), 16, 10).cast("int") >= 8
    sign = F.when(turned, -1.0).otherwise(1.0)
    pair = F.concat_ws("|", F.least("winner", "loser"), F.greatest("winner", "loser"))
    fold = F.pmod(F.conv(F.substring(F.md5(pair), 1, 8), 16, 10).cast("long"), F.lit(FOLDS)).cast("int")
    return own.select("seq", F.zip_with("xw", "xl", lambda a, b: (a - b) * sign).alias("x"), F.when(turned, 0.0).otherwise(1.0).alias("y"), fold.alias("fold"))


@queries.add("battle_probe")
def battle_probe(spark: SparkSession, d: str) -> DataFrame:
    """How often a logistic probe names the winner of a pair of models that it has not seen, fold by fold."""
    rows = stored(battle_pairs(spark, d), "battle-pairs")
    return probe.fold_accuracy(rows, probe.fold_logits(rows, DIMS, FOLDS))


def win_rates(spark: SparkSession, d: str) -> DataFrame:
    """(key, x, y): a judge's win rates of models with enough battles, as outcomes of their vectors."""
    s = battles(spark, d).select("judge", F.explode(F.array(F.struct(F.col("winner").alias("model"), F.lit(1.0).alias("won")), F.struct(F.col("loser").alias("model"), F.lit(0.0).alias("won")))).alias("s"))
    rates = s.groupBy("judge", "s.model").agg(F.avg("s.won").alias("y"), F.count("*").alias("n")).where(F.col("n") >= LEAST)
    return rates.join(model_vectors(spark, d), "model").select(F.concat_ws("/", "judge", "model").alias("key"), "x", "y")


@queries.add("win_rate_probe")
def win_rate_probe(spark: SparkSession, d: str) -> DataFrame:
    """Each model's win rate told by a ridge on the vectors of all others."""
    return probe.left_out(stored(win_rates(spark, d), "win-rates"), "key", DIMS)
