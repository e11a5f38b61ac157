"""Queries over pairwise battles, which the events table stands in for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import rate
from gristmill.registering import Queries
from gristmill.session import table

queries = Queries()

BATTLES = """
b AS (SELECT event_id AS seq, user_id % 25 AS item, 'j' || (event_id % 3) AS judge, 'm' || (user_id % 7) AS model_a, 'm' || ((event_id * 7 + 3) % 8) AS model_b,
  floor(value)::BIGINT % 7 AS margin_a, (event_id * 5 + 1) % 6 AS margin_b FROM events WHERE user_id % 7 <> (event_id * 7 + 3) % 8),
w AS (SELECT *, CASE WHEN margin_a > margin_b THEN model_a ELSE model_b END AS winner, CASE WHEN margin_a > margin_b THEN model_b ELSE model_a END AS loser,
  CASE WHEN margin_a > margin_b THEN 'A' ELSE 'B' END AS label FROM b)
"""
PAIRED = """
c AS (SELECT item, seq, judge, least(model_a, model_b) AS model_1, greatest(model_a, model_b) AS model_2, model_a < model_b AS forward,
  CASE WHEN model_a < model_b THEN margin_a ELSE margin_b END AS m1, CASE WHEN model_a < model_b THEN margin_b ELSE margin_a END AS m2 FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY item, model_1, model_2, forward ORDER BY seq) AS i FROM c),
p AS (SELECT item, model_1, model_2, i::INT AS i, sum(m1)::BIGINT AS margin_1, sum(m2)::BIGINT AS margin_2, max(seq) AS seq FROM n GROUP BY 1, 2, 3, 4 HAVING count(*) = 2),
r AS (SELECT *, CASE WHEN margin_1 > margin_2 THEN 'model_1' WHEN margin_1 < margin_2 THEN 'model_2' ELSE 'draw' END AS result FROM p)
"""


def battles(spark: SparkSession, d: str) -> DataFrame:
    """item, seq, judge, both models, their margins, winner, loser and label; equal margins go to the second."""
    name = lambda c: F.concat(F.lit("m"), c.cast("string"))
    other = (F.col("event_id") * 7 + 3) % 8
    b = table(spark, d, "events").where(F.col("user_id") % 7 != other).select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 25).alias("item"), F.concat(F.lit("j"), (F.col("event_id") % 3).cast("string")).alias("judge"),
        name(F.col("user_id") % 7).alias("model_a"), name(other).alias("model_b"), (F.floor("value") % 7).alias("margin_a"), ((F.col("event_id") * 5 + 1) % 6).alias("margin_b"),
    )
    first = F.col("margin_a") > F.col("margin_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return b.withColumn("winner", pick("model_a", "model_b")).withColumn("loser", pick("model_b", "model_a")).withColumn("label", F.when(first, "A").otherwise("B"))


@queries.add("win_loss", f"WITH {BATTLES}, s AS (SELECT winner AS model, 1 AS won FROM w UNION ALL SELECT loser, 0 FROM w) SELECT model, sum(won)::BIGINT AS wins, (count(*) - sum(won))::BIGINT AS losses, count(*) AS total, round(sum(won) / count(*), 6)::DOUBLE AS win_rate FROM s GROUP BY 1")
def win_loss(spark: SparkSession, d: str) -> DataFrame:
    return rate.win_loss(battles(spark, d))


@queries.add("position_bias", f"WITH {BATTLES} SELECT judge, count(*) FILTER (WHERE label = 'A') AS first_wins, count(*) FILTER (WHERE label = 'B') AS second_wins, round(avg((label = 'A')::INT), 6) AS first_share FROM w GROUP BY 1")
def position_bias(spark: SparkSession, d: str) -> DataFrame:
    first = (F.col("label") == "A").cast("int")
    return battles(spark, d).groupBy("judge").agg(F.sum(first).alias("first_wins"), F.sum(1 - first).alias("second_wins"), F.round(F.avg(first), 6).alias("first_share"))


@queries.add(
    "pairing_coverage",
    f"""WITH {BATTLES}, o AS (SELECT item, least(model_a, model_b) AS model_1, greatest(model_a, model_b) AS model_2, count(*) FILTER (WHERE model_a < model_b) AS f, count(*) FILTER (WHERE model_a > model_b) AS r FROM b GROUP BY 1, 2, 3)
SELECT model_1, count(*) AS pairs, count(*) FILTER (WHERE f > 0 AND r > 0) AS both_ways, count(*) FILTER (WHERE f = r) AS balanced, sum(abs(f - r))::BIGINT AS backlog, count(*) FILTER (WHERE f = 0 OR r = 0) AS unpaired FROM o GROUP BY 1""",
)
def pairing_coverage(spark: SparkSession, d: str) -> DataFrame:
    pair = battles(spark, d).select("item", *rate.ordered_pair("model_a", "model_b"))
    o = pair.groupBy("item", "model_1", "model_2").agg(F.count_if("forward").alias("f"), F.count_if(~F.col("forward")).alias("r"))
    f, r = F.col("f"), F.col("r")
    return o.groupBy("model_1").agg(F.count("*").alias("pairs"), F.count_if((f > 0) & (r > 0)).alias("both_ways"), F.count_if(f == r).alias("balanced"), F.sum(F.abs(f - r)).alias("backlog"), F.count_if((f == 0) | (r == 0)).alias("unpaired"))


@queries.add("paired_results", f"WITH {BATTLES}, {PAIRED} SELECT * FROM r")
def paired_results(spark: SparkSession, d: str) -> DataFrame:
    return rate.paired_results(battles(spark, d))


@queries.add(
    "first_pairs",
    f"""WITH {BATTLES}, {PAIRED} SELECT item, model_1, model_2, margin_1, margin_2, result FROM r WHERE i = 1""",
)
def first_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Only the first battle of each orientation counts."""
    return rate.paired_results(battles(spark, d)).where("i = 1").select("item", "model_1", "model_2", "margin_1", "margin_2", "result")


@queries.add(
    "margins_by_axis",
    f"""WITH {BATTLES}, x AS (SELECT judge AS axis, winner AS model, abs(margin_a - margin_b) AS margin FROM w UNION ALL SELECT 'all', winner, abs(margin_a - margin_b) FROM w)
SELECT axis, model, count(*) AS wins, sum(margin)::BIGINT AS margin FROM x GROUP BY 1, 2""",
)
def margins_by_axis(spark: SparkSession, d: str) -> DataFrame:
    """Margins by axis (the judge) and summed over all axes."""
    own = battles(spark, d).select(F.explode(F.array("judge", F.lit("all"))).alias("axis"), F.col("winner").alias("model"), F.abs(F.col("margin_a") - F.col("margin_b")).alias("margin"))
    return own.groupBy("axis", "model").agg(F.count("*").alias("wins"), F.sum("margin").alias("margin"))


@queries.add(
    "agreement",
    f"""WITH {BATTLES}, v AS (SELECT item, model_a, model_b, judge, avg((label = 'A')::INT) > 0.5 AS a_wins, avg(margin_a - margin_b) AS diff FROM w GROUP BY 1, 2, 3, 4)
SELECT x.judge AS judge_1, y.judge AS judge_2, count(*) AS n, round(avg((x.a_wins = y.a_wins)::INT), 6) AS agree, round(avg(abs(x.diff - y.diff)), 6) AS mean_gap
FROM v x JOIN v y USING (item, model_a, model_b) WHERE x.judge < y.judge GROUP BY 1, 2""",
)
def agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often two judges agree on the same ordered pair and item, and how far their margins lie apart."""
    v = battles(spark, d).groupBy("item", "model_a", "model_b", "judge").agg((F.avg((F.col("label") == "A").cast("int")) > 0.5).alias("wins"), F.avg(F.col("margin_a") - F.col("margin_b")).alias("diff"))
    y = v.select("item", "model_a", "model_b", F.col("judge").alias("judge_2"), F.col("wins").alias("wins_2"), F.col("diff").alias("diff_2"))
    pairs = v.join(y, ["item", "model_a", "model_b"]).where("judge < judge_2")
    return pairs.groupBy(F.col("judge").alias("judge_1"), "judge_2").agg(F.count("*").alias("n"), F.round(F.avg((F.col("wins") == F.col("wins_2")).cast("int")), 6).alias("agree"), F.round(F.avg(F.abs(F.col("diff") - F.col("diff_2"))), 6).alias("mean_gap"))


@queries.add(
    "winner_deltas",
    f"""WITH {BATTLES}, f AS (SELECT 'm' || (user_id % 8) AS model, avg(value) AS x, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT judge, count(*) AS n, round(avg(a.x - c.x), 5) AS mean_delta, round(avg(a.x - c.x) / (stddev_pop(a.x - c.x) / sqrt(count(*))), 4) AS t, round(avg((a.x > c.x)::INT), 6) AS share
FROM w JOIN f a ON winner = a.model JOIN f c ON loser = c.model GROUP BY 1""",
)
def winner_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Winner minus loser in a feature of the models, with a t value and the share of positive ones."""
    f = table(spark, d, "events").where("event_type != 'view'").groupBy(F.concat(F.lit("m"), (F.col("user_id") % 8).cast("string")).alias("winner")).agg(F.avg("value").alias("x"))
    lost = f.select(F.col("winner").alias("loser"), F.col("x").alias("y"))
    delta = F.col("x") - F.col("y")
    own = battles(spark, d).join(f, "winner").join(lost, "loser")
    return own.groupBy("judge").agg(F.count("*").alias("n"), F.round(F.avg(delta), 5).alias("mean_delta"), F.round(F.avg(delta) / (F.stddev_pop(delta) / F.sqrt(F.count("*"))), 4).alias("t"), F.round(F.avg((delta > 0).cast("int")), 6).alias("share"))


@queries.add("skill_ratings")
def skill_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of each item's models by the paired results; the fold has no SQL form."""
    return rate.skill_ratings(rate.paired_results(battles(spark, d)), "item", 0.03)


@queries.add("bradley_terry")
def bradley_terry(spark: SparkSession, d: str) -> DataFrame:
    return rate.bradley_terry(rate.paired_results(battles(spark, d)), "item")


@queries.add("style_controlled")
def style_controlled(spark: SparkSession, d: str) -> DataFrame:
    """Strengths with and without a style covariate, and the shift between them."""
    style = table(spark, d, "events").where("event_type != 'view'").groupBy(F.concat(F.lit("m"), (F.col("user_id") % 8).cast("string")).alias("m")).agg(F.avg("value").alias("x"))
    side = lambda who, name: style.select(F.col("m").alias(who), F.col("x").alias(name))
    own = battles(spark, d).join(side("winner", "xw"), "winner").join(side("loser", "xl"), "loser")
    # The covariate is a battle's own: margins vary it, so that it is more than a name of its models.
    own = own.withColumn("delta", F.col("xw") - F.col("xl") + F.col("seq") % 5).persist()
    raw = rate.controlled_strengths(own, [], "seq")[0].withColumnRenamed("strength", "raw")
    kept = rate.controlled_strengths(own, ["delta"], "seq")[0].withColumnRenamed("strength", "controlled")
    return raw.join(kept, "model").withColumn("shift", F.col("controlled") - F.col("raw"))
