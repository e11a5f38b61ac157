"""Queries on what a tournament plays next and on how verdicts are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.operators import match as M
from gristmill.operators import rate
from gristmill.plans.battles import BATTLES, battles
from gristmill.registering import Queries
from gristmill.session import table

queries = Queries()

OPEN = f"""{BATTLES.strip()}, models AS (SELECT 'm' || k AS model FROM range(8) t(k)), items AS (SELECT DISTINCT item FROM b),
every AS (SELECT item, x.model AS model_a, y.model AS model_b FROM items, models x, models y WHERE x.model <> y.model),
d AS (SELECT DISTINCT item, model_a, model_b FROM b WHERE judge = 'j1'),
o AS (SELECT e.*, EXISTS (SELECT 1 FROM d WHERE d.item = e.item AND d.model_a = e.model_b AND d.model_b = e.model_a) AS turned FROM every e WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.item = e.item AND d.model_a = e.model_a AND d.model_b = e.model_b))"""
#: Ratings from the battles: the share of wins around 25, surer with every battle; on the second axis the margins'.
RATED = """sides AS (SELECT model_a AS m, (label = 'A')::INT AS won, margin_a - margin_b AS margin FROM w UNION ALL SELECT model_b, (label = 'B')::INT, margin_b - margin_a FROM w),
r AS (SELECT m, 25 + 20 * (avg(won) - 0.5) AS mu, 25 / 3.0 / sqrt(1 + count(*) / 100.0) AS sigma, 25 + avg(margin) AS mu2, 25 / 3.0 / sqrt(1 + count(*) / 50.0) AS sigma2 FROM sides GROUP BY 1)"""
GAIN = "(a.{1} + c.{1}) * sqrt(2 * {b} / (2 * {b} + a.{1} * a.{1} + c.{1} * c.{1})) * exp(-power(a.{0} - c.{0}, 2) / (2 * (2 * {b} + a.{1} * a.{1} + c.{1} * c.{1})))"
ONE = GAIN.format("mu", "sigma", b=M.BETA2)
TWO = GAIN.format("mu2", "sigma2", b=M.BETA2)
UNITS = "p AS (SELECT o.*, least(model_a, model_b) AS model_1, greatest(model_a, model_b) AS model_2 FROM o), q AS (SELECT p.*, gain FROM p JOIN g USING (model_1, model_2))"


def open_matches(spark: SparkSession, d: str) -> DataFrame:
    own = battles(spark, d)
    items = own.select("item").distinct()
    models = items.join(spark.range(8).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("model")))  # who answered what: all, here
    return M.pending(items, models, own, "j1")


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """m, mu, sigma and the same on a second axis, from all battles."""
    gap = F.col("margin_a") - F.col("margin_b")
    side = lambda who, label, margin: F.struct(F.col(who).alias("m"), (F.col("label") == label).cast("int").alias("won"), margin.alias("margin"))
    s = battles(spark, d).select(F.inline(F.array(side("model_a", "A", gap), side("model_b", "B", -gap))))
    sure = lambda n: F.lit(25 / 3.0) / F.sqrt(1 + F.count("*") / n)
    return s.groupBy("m").agg((25 + 20 * (F.avg("won") - 0.5)).alias("mu"), sure(100.0).alias("sigma"), (25 + F.avg("margin")).alias("mu2"), sure(50.0).alias("sigma2"))


def pair_gains(spark: SparkSession, d: str, both_axes: bool = False) -> DataFrame:
    a, c = ratings(spark, d).alias("a"), ratings(spark, d).alias("c")
    g = M.gain(F.col("a.mu"), F.col("a.sigma"), F.col("c.mu"), F.col("c.sigma"))
    if both_axes:
        g = g + M.gain(F.col("a.mu2"), F.col("a.sigma2"), F.col("c.mu2"), F.col("c.sigma2"))
    return a.join(c, F.col("a.m") < F.col("c.m")).select(F.col("a.m").alias("model_1"), F.col("c.m").alias("model_2"), g.alias("gain"))


@queries.add("pending_matches", f"WITH {OPEN} SELECT item, model_a, model_b, turned FROM o")
def pending_matches(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pairs of models that a judge has not yet seen on an item."""
    return open_matches(spark, d).select("item", "model_a", "model_b", "turned")


CHOICE = """first AS (SELECT item, model_a, model_b, gain FROM q WHERE turned ORDER BY round(gain, 9) DESC, model_1, model_2, item LIMIT {0}),
u AS (SELECT model_1, model_2, arg_min(item, (md5('0:' || item || ':' || model_1 || ':' || model_2), item)) AS item, any_value(gain) AS gain FROM q WHERE NOT turned GROUP BY 1, 2),
n AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY round(gain, 9) DESC, model_1, model_2, item) AS k FROM u) WHERE k <= ({0} - (SELECT count(*) FROM first)) // 2)
SELECT item, model_a, model_b, round(gain, 6) AS gain, 'completion' AS reason FROM first UNION ALL SELECT item, model_1, model_2, round(gain, 6), 'new' FROM n UNION ALL SELECT item, model_2, model_1, round(gain, 6), 'new' FROM n"""


@queries.add("match_selection", f"WITH {OPEN}, {RATED}, g AS (SELECT a.m AS model_1, c.m AS model_2, {ONE} AS gain FROM r a JOIN r c ON a.m < c.m), {UNITS}, {CHOICE.format(300)}")
def match_selection(spark: SparkSession, d: str) -> DataFrame:
    """Within a budget: first what is half done, then new pairs with both orientations, by gain."""
    return M.selected(open_matches(spark, d), pair_gains(spark, d), 300).withColumn("gain", F.round("gain", 6))


@queries.add("match_selection_two_axes", f"WITH {OPEN}, {RATED}, g AS (SELECT a.m AS model_1, c.m AS model_2, {ONE} + {TWO} AS gain FROM r a JOIN r c ON a.m < c.m), {UNITS} SELECT item, model_a, model_b, round(gain, 6) AS gain FROM q ORDER BY round(gain, 9) DESC, model_a, model_b, item LIMIT 200")
def match_selection_two_axes(spark: SparkSession, d: str) -> DataFrame:
    """By the sum of the gains on two axes; orientations one by one."""
    o = open_matches(spark, d).select("item", "model_a", "model_b", F.least("model_a", "model_b").alias("model_1"), F.greatest("model_a", "model_b").alias("model_2"))
    best = o.join(pair_gains(spark, d, True), ["model_1", "model_2"]).orderBy(F.desc(F.round("gain", 9)), "model_a", "model_b", "item").limit(200)
    return best.select("item", "model_a", "model_b", F.round("gain", 6).alias("gain"))


@queries.add("matches_by_skill")
def matches_by_skill(spark: SparkSession, d: str) -> DataFrame:
    """As match_selection, with ratings of all paired results as the tournament keeps them."""
    rated = rate.skill_ratings(rate.paired_results(battles(spark, d)), "item", 0.03).groupBy("model").agg(F.avg("mu").alias("mu"), (F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))) / F.count("*")).alias("sigma"))
    rated = rated.withColumnRenamed("model", "m")
    a, c = rated.alias("a"), rated.alias("c")
    gains = a.join(c, F.col("a.m") < F.col("c.m")).select(F.col("a.m").alias("model_1"), F.col("c.m").alias("model_2"), M.gain(F.col("a.mu"), F.col("a.sigma"), F.col("c.mu"), F.col("c.sigma")).alias("gain"))
    return M.selected(open_matches(spark, d), gains, 300)


@queries.add("battles_by_model", f"WITH {BATTLES}, s AS (SELECT model_a AS model, judge, item FROM b UNION ALL SELECT model_b, judge, item FROM b) SELECT model, count(*) AS battles, count(DISTINCT judge) AS judges, count(DISTINCT item) AS items FROM s GROUP BY 1")
def battles_by_model(spark: SparkSession, d: str) -> DataFrame:
    sides = battles(spark, d).select(F.explode(F.array("model_a", "model_b")).alias("model"), "judge", "item")
    return sides.groupBy("model").agg(F.count("*").alias("battles"), F.count_distinct("judge").alias("judges"), F.count_distinct("item").alias("items"))


@queries.add(
    "paired_by_axis",
    f"""WITH {BATTLES}, x AS (SELECT judge AS axis, * EXCLUDE judge FROM b UNION ALL SELECT 'all', * EXCLUDE judge FROM b),
c AS (SELECT axis, item, least(model_a, model_b) AS model_1, greatest(model_a, model_b) AS model_2, model_a < model_b AS f, CASE WHEN model_a < model_b THEN margin_a - margin_b ELSE margin_b - margin_a END AS m FROM x)
SELECT axis, item, model_1, model_2, sum(m)::BIGINT AS margin, CASE WHEN sum(m) > 0 THEN 'model_1' WHEN sum(m) < 0 THEN 'model_2' ELSE 'draw' END AS result FROM c GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (WHERE f) > 0 AND count(*) FILTER (WHERE NOT f) > 0""",
)
def paired_by_axis(spark: SparkSession, d: str) -> DataFrame:
    """Paired results of each axis and of all together: pairs seen both ways, by the sum of their margins."""
    own = battles(spark, d).withColumn("axis", F.explode(F.array("judge", F.lit("all"))))
    m = F.when(F.col("model_a") < F.col("model_b"), F.col("margin_a") - F.col("margin_b")).otherwise(F.col("margin_b") - F.col("margin_a"))
    c = own.select("axis", "item", *rate.ordered_pair("model_a", "model_b"), m.alias("m"))
    g = c.groupBy("axis", "item", "model_1", "model_2").agg(F.sum("m").alias("margin"), F.count_if("forward").alias("f"), F.count_if(~F.col("forward")).alias("r")).where("f > 0 and r > 0")
    return g.select("axis", "item", "model_1", "model_2", "margin", F.when(F.col("margin") > 0, "model_1").when(F.col("margin") < 0, "model_2").otherwise("draw").alias("result"))


@queries.add("verdict_margins", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 5 + 1 END AS margin, event_id % 7 <> 0 AND event_id % 5 < 5 AND event_id % 11 <> 0 AS valid FROM events")
def verdict_margins(spark: SparkSession, d: str) -> DataFrame:
    """Margins by plus signs, and whether a payload has exactly the criteria with well-formed verdicts; some are
    broken: a code that is none, a criterion that is missing."""
    k = F.col("event_id")
    code = F.when(k % 2 == 0, "A0493").otherwise("A0488")
    text = F.concat(F.when(k % 7 == 0, "B17").otherwise(code), F.repeat(F.lit("+"), (k % 5 + 1).cast("int")))
    payload = F.when(k % 11 == 0, F.create_map(F.lit("logic"), text)).otherwise(F.create_map(F.lit("logic"), text, F.lit("style"), F.concat(code, F.lit("+"))))
    own = table(spark, d, "events").select("event_id", text.alias("t"), payload.alias("p"))
    return own.select("event_id", M.plus_margin(F.col("t")).cast("long").alias("margin"), M.valid_payload(F.col("p"), ["logic", "style"]).alias("valid"))


@queries.add("slot_labels", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'third' END AS slot FROM documents WHERE doc_id % 3 < 2")
def slot_labels(spark: SparkSession, d: str) -> DataFrame:
    """The slot that a prompt id ends with; other ids drop out."""
    prompt = F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.element_at(F.array(F.lit("_t1"), F.lit("_t3"), F.lit("_t7")), (F.col("doc_id") % 3 + 1).cast("int")))
    part = F.regexp_extract(prompt, "_t([^_]*)$", 1)
    slot = F.when(part == "1", "first").when(part == "3", "third")
    return table(spark, d, "documents").select("doc_id", slot.alias("slot")).where("slot is not null")


@queries.add(
    "judgement_work",
    """WITH l AS (SELECT user_id AS model, CAST(json_extract(props, '$.k') AS BIGINT) % 12 AS question, arg_max(event_id, (ts, event_id)) AS answer FROM events GROUP BY 1, 2),
w AS (SELECT model, question, answer, 'j' || j AS judge, rep FROM l, range(2) a(j), range(2) b(rep))
SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = w.model AND 'j' || (e.event_id % 5) = w.judge AND CAST(json_extract(e.props, '$.k') AS BIGINT) % 12 = w.question AND e.event_type = 'purchase' AND rep = 0)""",
)
def judgement_work(spark: SparkSession, d: str) -> DataFrame:
    """The last answer of each model and question, for every judge and replicate, minus what is judged."""
    e = table(spark, d, "events").withColumn("question", F.get_json_object("props", "$.k").cast("long") % 12)
    last = e.groupBy(F.col("user_id").alias("model"), "question").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("answer"))
    judges = F.explode(F.array(F.lit("j0"), F.lit("j1")))
    work = last.withColumn("judge", judges).withColumn("rep", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    done = e.where("event_type = 'purchase'").select(F.col("user_id").alias("model"), "question", F.concat(F.lit("j"), (F.col("event_id") % 5).cast("string")).alias("judge"), F.lit(0).cast("long").alias("rep")).distinct()
    return work.join(done, ["model", "question", "judge", "rep"], "left_anti").select("model", "question", "answer", "judge", "rep")


@queries.add("worst_first", "SELECT event_type, event_id, place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - 50) DESC, event_id) AS place FROM events) WHERE place <= 20")
def worst_first(spark: SparkSession, d: str) -> DataFrame:
    """The cells of each column that stand furthest off, worst first."""
    w = Window.partitionBy("event_type").orderBy(F.desc(F.abs(F.col("value") - 50)), "event_id")
    return table(spark, d, "events").select("event_type", "event_id", F.row_number().over(w).cast("long").alias("place")).where("place <= 20")


@queries.add("initial_items", "SELECT DISTINCT user_id % 150 AS item FROM events WHERE user_id % 150 IN (1, 2, 6, 101, 131)")
def initial_items(spark: SparkSession, d: str) -> DataFrame:
    """The stated first set of items."""
    return table(spark, d, "events").select((F.col("user_id") % 150).alias("item")).where(F.col("item").isin(1, 2, 6, 101, 131)).distinct()
