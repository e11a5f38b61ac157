"""Queries that report: pivots, agreement, bootstrap intervals, clusters, trials, joined feature frames."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.operators import rank as R
from gristmill.operators.bootstrap import PRIME, resampled
from gristmill.operators.correlate import pairs, rank_pairs
from gristmill.operators.exact import quantiles
from gristmill.plans.battles import BATTLES, battles
from gristmill.plans.scoring import ANSWERS, answers
from gristmill.registering import Queries
from gristmill.session import table

queries = Queries()
TYPES = ("click", "error", "purchase", "signup", "view")


@queries.add(
    "conflict_samples",
    """WITH k AS (SELECT l_orderkey AS key, count(*) AS n_rows, count(DISTINCT l_returnflag) AS a, count(DISTINCT l_linestatus) AS b, list_sort(list(DISTINCT l_returnflag)) AS va, list_sort(list(DISTINCT l_linestatus)) AS vb FROM lineitem GROUP BY 1)
SELECT key, n_rows, (a > 1)::INT::BIGINT + (b > 1)::INT AS n_columns, CASE WHEN a > 1 THEN array_to_string(va[1:5], ',') END AS flags, CASE WHEN b > 1 THEN array_to_string(vb[1:5], ',') END AS states FROM k WHERE n_rows > 1 AND (a > 1 OR b > 1) ORDER BY n_columns DESC, n_rows DESC, key LIMIT 200""",
)
def conflict_samples(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose rows contradict each other, the worst first, with up to five values of each such column.

    Sets give both the values and their number, so that rows are not multiplied for distinct counts."""
    sets = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("n_rows"), F.collect_set("l_returnflag").alias("va"), F.collect_set("l_linestatus").alias("vb"))
    five = lambda c: F.slice(F.sort_array(c), 1, 5).alias(c)
    k = sets.select("key", "n_rows", F.size("va").alias("a"), F.size("vb").alias("b"), five("va"), five("vb"))
    n = (F.col("a") > 1).cast("long") + (F.col("b") > 1).cast("long")
    bad = k.where("n_rows > 1").select("key", "n_rows", n.alias("n_columns"), F.when(F.col("a") > 1, F.array_join("va", ",")).alias("flags"), F.when(F.col("b") > 1, F.array_join("vb", ",")).alias("states")).where("n_columns > 0")
    return bad.orderBy(F.desc("n_columns"), F.desc("n_rows"), "key").limit(200)


@queries.add("writer_judge_pivot", f"WITH {BATTLES} SELECT winner AS writer, " + ", ".join(f"round(avg(margin_a) FILTER (WHERE judge = 'j{j}'), 6) AS j{j}" for j in range(3)) + " FROM w GROUP BY 1")
def writer_judge_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = battles(spark, d).groupBy(F.col("winner").alias("writer")).pivot("judge", ["j0", "j1", "j2"])
    return wide.agg(F.round(F.avg("margin_a"), 6))


@queries.add("writer_question_pivot", f"WITH {BATTLES} SELECT winner AS writer, " + ", ".join(f"round(avg(margin_b) FILTER (WHERE item = {q}), 6) AS q{q}" for q in range(25)) + " FROM w GROUP BY 1")
def writer_question_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = battles(spark, d).groupBy(F.col("winner").alias("writer")).pivot("item", list(range(25))).agg(F.round(F.avg("margin_b"), 6))
    return wide.select("writer", *[F.col(str(q)).alias(f"q{q}") for q in range(25)])


JUDGED = "s AS (SELECT event_type AS judge, user_id AS model, avg(value) AS x FROM events GROUP BY 1, 2), j AS (SELECT model, " + ", ".join(f"max(x) FILTER (WHERE judge = '{t}') AS {t}" for t in TYPES) + " FROM s GROUP BY 1)"


@queries.add("judge_correlations", f"WITH {JUDGED} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 6) AS r FROM j" for a, b in combinations(TYPES, 2)))
def judge_correlations(spark: SparkSession, d: str) -> DataFrame:
    """How alike judges score the same models, pair by pair."""
    wide = table(spark, d, "events").groupBy("user_id").pivot("event_type", list(TYPES)).agg(F.avg("value"))
    return pairs(wide, TYPES).withColumn("r", F.round("r", 6))


@queries.add(
    "alpha_by_question",
    f"""WITH {ANSWERS}, s AS (SELECT question, model, label, avg(value) AS x FROM a GROUP BY 1, 2, 3), f AS (SELECT question, model, sum(x) AS total FROM s GROUP BY 1, 2 HAVING count(*) = 3),
k AS (SELECT s.* FROM s JOIN f USING (question, model)), v AS (SELECT question, sum(v) AS parts FROM (SELECT question, label, variance(x) AS v FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT question, count(*) AS n, round(1.5 * (1 - any_value(parts) / variance(total)), 5)::DOUBLE AS alpha FROM f JOIN v USING (question) GROUP BY 1 HAVING count(*) > 1""",
)
def alpha_by_question(spark: SparkSession, d: str) -> DataFrame:
    """Cronbach's alpha of three judges for each question, over the models that all three have scored."""
    s = answers(spark, d).groupBy("question", "model", "label").agg(F.avg("value").alias("x"))
    whole = s.groupBy("question", "model").agg(F.sum("x").alias("total"), F.count("*").alias("n")).where("n = 3").drop("n")
    parts = s.join(whole, ["question", "model"]).groupBy("question", "label").agg(F.variance("x").alias("v")).groupBy("question").agg(F.sum("v").alias("parts"))
    t = whole.groupBy("question").agg(F.count("*").alias("n"), F.variance("total").alias("v")).where("n > 1")
    return t.join(parts, "question").select("question", "n", F.round(1.5 * (1 - F.col("parts") / F.col("v")), 5).alias("alpha"))


DRAWS = 2000
#: A draw's number for a row, by rule: the key and the draw mixed by squaring modulo a prime, over the prime.
MIXED = f"""h AS (SELECT *, ((key % {PRIME}) * 48271 + k * 69621 + 12345) % {PRIME} AS x0 FROM b, range({DRAWS}) t(k)),
h1 AS (SELECT *, (x0 * x0 + 7 * x0 + 11) % {PRIME} AS x1 FROM h), h2 AS (SELECT *, ((x1 * x1 + 13 * x1 + 17) % {PRIME}) / {PRIME}.0::DOUBLE AS u FROM h1)"""
POISSON = "CASE WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.9196986 THEN 2 WHEN u < 0.98101184 THEN 3 WHEN u < 0.99634015 THEN 4 ELSE 5 END"


@queries.add(
    "bootstrap_metrics",
    f"""WITH b AS (SELECT o_orderkey AS key, o_totalprice - o_custkey * 300.0 AS e FROM orders), {MIXED}, x AS (SELECT k, e, {POISSON} AS w FROM h2),
m AS (SELECT k, sqrt(sum(w * e * e) / sum(w)) AS rmse, sum(w * abs(e)) / sum(w) AS mae FROM x GROUP BY 1)
SELECT round(quantile_cont(rmse, 0.025), 4) AS rmse_low, round(quantile_cont(rmse, 0.975), 4) AS rmse_high, round(quantile_cont(mae, 0.025), 4) AS mae_low, round(quantile_cont(mae, 0.975), 4) AS mae_high FROM m""",
)
def bootstrap_metrics(spark: SparkSession, d: str) -> DataFrame:
    """95 % intervals of error measures by a Poisson bootstrap of 2 000 draws: each row counts 0, 1, 2, ... times in a
    draw, a draw is a weighted sum, and one pass adds up all draws."""
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") - F.col("o_custkey") * 300.0).alias("e"))
    n, squares, sizes = resampled(p, "key", [F.lit(1.0), F.col("e") * F.col("e"), F.abs("e")], DRAWS)
    rmse, mae = np.sqrt(squares / n), sizes / n
    ends = [round(float(np.quantile(v, q)), 4) for v in (rmse, mae) for q in (0.025, 0.975)]
    return spark.createDataFrame([tuple(ends)], "rmse_low double, rmse_high double, mae_low double, mae_high double")


@queries.add(
    "bootstrap_calibration",
    f"""WITH p AS (SELECT o_orderkey AS key, o_totalprice AS y, o_custkey * 300.0 AS p FROM orders), e AS (SELECT quantile_cont(p, 0.25) AS a, quantile_cont(p, 0.5) AS b, quantile_cont(p, 0.75) AS c FROM p),
b AS (SELECT key, y - p AS gap, CASE WHEN p <= a THEN 0 WHEN p <= b THEN 1 WHEN p <= c THEN 2 ELSE 3 END AS bin FROM p, e), {MIXED},
x AS (SELECT bin, k, gap, {POISSON} AS w FROM h2), m AS (SELECT bin, k, sum(w * gap) / sum(w) AS gap FROM x GROUP BY 1, 2)
SELECT bin, round(quantile_cont(gap, 0.025), 3) AS low, round(quantile_cont(gap, 0.975), 3) AS high FROM m GROUP BY 1""",
)
def bootstrap_calibration(spark: SparkSession, d: str) -> DataFrame:
    """The mean gap between actual and predicted by bins of the prediction, with bootstrap intervals of 2 000 draws."""
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("y"), (F.col("o_custkey") * 300.0).alias("p"))
    e = quantiles(p, {"p": [0.25, 0.5, 0.75]})["p"]
    bin_ = F.when(F.col("p") <= e[0], 0).when(F.col("p") <= e[1], 1).when(F.col("p") <= e[2], 2).otherwise(3)
    own = p.select("key", bin_.alias("bin"), (F.col("y") - F.col("p")).alias("gap"))
    inside = [(F.col("bin") == b).cast("double") for b in range(4)]
    s = resampled(own, "key", [*inside, *[i * F.col("gap") for i in inside]], DRAWS)
    rows = [(b, *(round(float(np.quantile(s[4 + b] / s[b], q)), 3) for q in (0.025, 0.975))) for b in range(4) if s[b].all()]
    return spark.createDataFrame(rows, "bin int, low double, high double")


@queries.add("rank_metric", "WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS x, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS y FROM orders) SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r")
def rank_metric(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's coefficient of actual and predicted over a whole table."""
    return rank_pairs(table(spark, d, "orders").select("o_totalprice", "o_custkey"), ["o_totalprice", "o_custkey"]).select("n", F.round("rho", 6).alias("rho"))


@queries.add(
    "recommended_setting",
    """WITH e AS (SELECT quantile_cont(o_totalprice, 0.9) AS hi FROM orders), t AS (SELECT o_orderkey, o_orderpriority FROM orders, e WHERE o_totalprice >= hi)
SELECT (SELECT median(o_orderkey) FROM t)::DOUBLE AS numeric_setting, (SELECT o_orderpriority FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS choice""",
)
def recommended_setting(spark: SparkSession, d: str) -> DataFrame:
    """What the best tenth of the trials recommends: the median of a number, the mode of a choice."""
    orders = table(spark, d, "orders")
    (hi,) = quantiles(orders, {"o_totalprice": [0.9]})["o_totalprice"]
    top = orders.where(F.col("o_totalprice") >= hi)
    (middle,) = quantiles(top, {"o_orderkey": [0.5]})["o_orderkey"]
    mode = top.groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority").limit(1)
    return mode.select(F.lit(middle).alias("numeric_setting"), F.col("o_orderpriority").alias("choice"))


@queries.add(
    "distinctive_columns",
    """WITH c AS (SELECT l_returnflag AS cluster, 'l_quantity' AS col, avg(l_quantity) AS m FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_extendedprice', avg(l_extendedprice) FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_discount', avg(l_discount) FROM lineitem GROUP BY 1),
z AS (SELECT *, (m - avg(m) OVER (PARTITION BY col)) / stddev_pop(m) OVER (PARTITION BY col) AS z FROM c) SELECT cluster, col, round(z, 4) AS z, place FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(abs(z), 9) DESC, col) AS place FROM z) WHERE place <= 2""",
)
def distinctive_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns in which each cluster stands out most, by z-scores of cluster means."""
    cells = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("cluster"), F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in ("l_quantity", "l_extendedprice", "l_discount")])))
    m = cells.groupBy("cluster", "col").agg(F.avg("v").alias("m"))
    w = Window.partitionBy("col")
    z = m.select("cluster", "col", ((F.col("m") - F.avg("m").over(w)) / F.stddev_pop("m").over(w)).alias("z"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round(F.abs("z"), 9)), "col"))
    return z.select("cluster", "col", F.round("z", 4).alias("z"), place.cast("long").alias("place")).where("place <= 2")


@queries.add(
    "cluster_gains",
    """WITH g AS (SELECT event_type AS cluster, user_id AS feature, sum(value) AS gain FROM events GROUP BY 1, 2), c AS (SELECT cluster, sum(gain) AS total, count(*) AS features FROM g GROUP BY 1)
SELECT cluster, features, round(total, 3) AS gain, sum(features) OVER (ORDER BY round(total, 6) DESC, cluster)::BIGINT AS features_so_far, round(sum(total) OVER (ORDER BY round(total, 6) DESC, cluster) / sum(total) OVER (), 6) AS share_so_far FROM c""",
)
def cluster_gains(spark: SparkSession, d: str) -> DataFrame:
    """What each cluster of features adds, the best first, with the set that has been taken in by then (a row a cluster)."""
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("cluster"), "user_id").agg(F.sum("value").alias("gain"))
    c = g.groupBy("cluster").agg(F.sum("gain").alias("total"), F.count("*").alias("features"))
    w = Window.orderBy(F.desc(F.round("total", 6)), "cluster").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("total").over(w) / F.sum("total").over(Window.partitionBy())
    return c.select("cluster", "features", F.round("total", 3).alias("gain"), F.sum("features").over(w).alias("features_so_far"), F.round(share, 6).alias("share_so_far"))


@queries.add(
    "parameter_effects",
    """WITH t AS (SELECT o_totalprice AS score, 'custkey' AS param, o_custkey::DOUBLE AS v FROM orders UNION ALL SELECT o_totalprice, 'orderkey', o_orderkey::DOUBLE FROM orders UNION ALL SELECT o_totalprice, 'priority', ascii(o_orderpriority)::DOUBLE FROM orders)
SELECT param, count(*) AS n, round(corr(v, score), 7) AS r, row_number() OVER (ORDER BY abs(corr(v, score)) DESC, param) AS place FROM t GROUP BY 1 HAVING count(*) >= 10""",
)
def parameter_effects(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of every trial parameter with the score, the strongest first (a row for each parameter)."""
    o = table(spark, d, "orders")
    cells = F.array(*[F.struct(F.lit(n).alias("param"), c.cast("double").alias("v")) for n, c in (("custkey", F.col("o_custkey")), ("orderkey", F.col("o_orderkey")), ("priority", F.ascii("o_orderpriority")))])
    g = o.select("o_totalprice", F.inline(cells)).groupBy("param").agg(F.count("*").alias("n"), F.corr("v", "o_totalprice").alias("r")).where("n >= 10")
    return g.select("param", "n", F.round("r", 7).alias("r"), F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "param")).cast("long").alias("place"))


@queries.add("top_trials", "WITH p AS (SELECT l_orderkey, string_agg(l_linenumber || '=' || l_partkey, ';' ORDER BY l_linenumber, l_partkey) AS params FROM lineitem GROUP BY 1) SELECT o_orderkey, o_totalprice, params FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15) o LEFT JOIN p ON l_orderkey = o_orderkey")
def top_trials(spark: SparkSession, d: str) -> DataFrame:
    """The best trials with their parameters in one text; only their parameters are gathered."""
    top = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey", "o_totalprice")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    met = top.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    g = met.groupBy("o_orderkey", "o_totalprice").agg(F.sort_array(F.collect_list(F.when(F.col("l_orderkey").isNotNull(), F.struct("l_linenumber", "l_partkey")))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: F.concat_ws("=", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ";")
    return g.select("o_orderkey", "o_totalprice", F.when(F.size("all") > 0, text).alias("params"))


@queries.add("nested_metrics", "SELECT event_id, round(value, 1) AS a, CASE WHEN event_id % 3 <> 0 THEN round(value / 3, 2) END AS b, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS c FROM events WHERE value > 0 AND event_id % 7 <> 0")
def nested_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Three metrics out of nested JSON, rounded; missing and broken parts stay null; only rows with a positive first
    metric are kept."""
    k = F.col("event_id")
    parts = F.concat_ws(", ", F.format_string('"a": {"v": %s}', F.col("value").cast("string")), F.when(k % 3 != 0, F.format_string('"b": {"v": %s}', (F.col("value") / 3).cast("string"))), F.when(k % 5 != 0, F.format_string('"c": %s', F.get_json_object("props", "$.k"))))
    text = F.when(k % 7 == 0, "{broken").otherwise(F.concat(F.lit("{"), parts, F.lit("}")))
    j = F.from_json(text, "a struct<v: double>, b struct<v: double>, c bigint")
    own = table(spark, d, "events").select("event_id", j.alias("j"))
    return own.select("event_id", F.round("j.a.v", 1).alias("a"), F.round("j.b.v", 2).alias("b"), F.col("j.c").alias("c")).where(F.col("j.a.v") > 0)


@queries.add(
    "delta_frame",
    f"""WITH {ANSWERS}, q AS (SELECT model, question, avg(value) AS x FROM a GROUP BY 1, 2), s AS (SELECT model, avg(x) AS mean, stddev(x) AS sd, max(x) AS hi, min(x) AS lo FROM q GROUP BY 1),
t AS (SELECT user_id AS model, max(value) AS target FROM events WHERE event_type = 'purchase' GROUP BY 1), c AS (SELECT model, count(*) FILTER (WHERE label = 'correct') AS correct FROM a GROUP BY 1)
SELECT model, round(mean, 9) AS mean, round(sd / mean, 9) AS variation, round(hi - lo, 9) AS spread, correct, round(target, 4) AS target FROM s LEFT JOIN c USING (model) JOIN t USING (model)""",
)
def delta_frame(spark: SparkSession, d: str) -> DataFrame:
    """Features of each model from questions and counters, joined to the target that some models have."""
    own = answers(spark, d)
    q = own.groupBy("model", "question").agg(F.avg("value").alias("x"))
    s = q.groupBy("model").agg(F.avg("x").alias("mean"), F.stddev("x").alias("sd"), F.max("x").alias("hi"), F.min("x").alias("lo"))
    c = own.groupBy("model").agg(F.count_if(F.col("label") == "correct").alias("correct"))
    t = table(spark, d, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("model")).agg(F.max("value").alias("target"))
    met = s.join(c, "model", "left").join(t, "model")
    return met.select("model", F.round("mean", 9).alias("mean"), F.round(F.col("sd") / F.col("mean"), 9).alias("variation"), F.round(F.col("hi") - F.col("lo"), 9).alias("spread"), "correct", F.round("target", 4).alias("target"))


@queries.add("token_interactions", "SELECT l_orderkey, l_linenumber, round(l_quantity * ln(1 + l_extendedprice), 6) AS q_log, round(l_quantity * l_quantity, 4) AS squared, (l_extendedprice > 40000)::INT AS is_reasoner, round((l_quantity * 4 / 7) * ln(1 + l_extendedprice * 4 / 7), 6) AS rescaled FROM lineitem")
def token_interactions(spark: SparkSession, d: str) -> DataFrame:
    """Products of a score with the log of tokens, squares and a flag, from raw and from rescaled sums."""
    q, e = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(q * F.log1p(e), 6).alias("q_log"), F.round(q * q, 4).alias("squared"), (e > 40000).cast("int").alias("is_reasoner"), F.round(q * 4 / 7 * F.log1p(e * 4 / 7), 6).alias("rescaled"))


@queries.add("vendor_means", "SELECT c_mktsegment AS vendor, round(avg(c_acctbal), 6) AS balance, round(avg(c_nationkey), 6) AS nation, round(100 * (avg(c_acctbal) - min(avg(c_acctbal)) OVER ()) / (max(avg(c_acctbal)) OVER () - min(avg(c_acctbal)) OVER ()), 4) AS scaled FROM customer GROUP BY 1")
def vendor_means(spark: SparkSession, d: str) -> DataFrame:
    """Means by vendor, and on a scale of 0 to 100 as a radar shows them (a row for each vendor)."""
    g = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("vendor")).agg(F.avg("c_acctbal").alias("b"), F.avg("c_nationkey").alias("n"))
    w = Window.partitionBy()
    scaled = 100 * (F.col("b") - F.min("b").over(w)) / (F.max("b").over(w) - F.min("b").over(w))
    return g.select("vendor", F.round("b", 6).alias("balance"), F.round("n", 6).alias("nation"), F.round(scaled, 4).alias("scaled"))


@queries.add("capability_over_time", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(max(o_totalprice), 4) AS best, round(max(max(o_totalprice)) OVER (ORDER BY strftime(o_orderdate, '%Y-%m')), 4) AS best_so_far FROM orders GROUP BY 1")
def capability_over_time(spark: SparkSession, d: str) -> DataFrame:
    """The best score of each month and of all months until then (a row for each month)."""
    g = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("best"))
    so_far = F.max("best").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return g.select("month", "n", F.round("best", 4).alias("best"), F.round(so_far, 4).alias("best_so_far"))


@queries.add("predicted_and_actual", "WITH m AS (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) AS predicted FROM lineitem GROUP BY 1) SELECT o_orderkey, predicted, o_totalprice AS actual, round(o_totalprice - predicted, 4) AS gap FROM orders JOIN m ON l_orderkey = o_orderkey ORDER BY predicted DESC, o_orderkey LIMIT 30")
def predicted_and_actual(spark: SparkSession, d: str) -> DataFrame:
    """The highest predictions beside what came of them."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    m = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum(price), 4).alias("predicted"))
    met = table(spark, d, "orders").join(m, "o_orderkey").orderBy(F.desc("predicted"), "o_orderkey").limit(30)
    return met.select("o_orderkey", "predicted", F.col("o_totalprice").alias("actual"), F.round(F.col("o_totalprice") - F.col("predicted"), 4).alias("gap"))


@queries.add("dated_features", "SELECT c_custkey, c_acctbal, max(o_orderdate)::DATE AS latest FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal IS NOT NULL GROUP BY 1, 2")
def dated_features(spark: SparkSession, d: str) -> DataFrame:
    """Rows with their date and feature joined on the left; those that lack either drop out."""
    dates = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.max("o_orderdate")).alias("latest"))
    met = table(spark, d, "customer").select("c_custkey", "c_acctbal").join(dates, "c_custkey", "left")
    return met.dropna(subset=["c_acctbal", "latest"])


@queries.add("collided_columns", "SELECT coalesce(n_nationkey, r_regionkey) AS id, n_name AS name, r_name AS name_dup FROM nation FULL OUTER JOIN region ON n_nationkey = r_regionkey")
def collided_columns(spark: SparkSession, d: str) -> DataFrame:
    """A full outer join of sources that share a column's name: the second gets a suffix, the order is kept."""
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    b = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    b = b.toDF(*[f"{c}_dup" if c in a.columns and c != "id" else c for c in b.columns])
    return a.join(b, "id", "full")


@queries.add("highlights", "SELECT name, ordinal, s_acctbal FROM (SELECT unnest(['Supplier#000000003', 'none', 'Supplier#000000001']) AS name, unnest([1, 2, 3])::BIGINT AS ordinal) JOIN supplier ON s_name = name")
def highlights(spark: SparkSession, d: str) -> DataFrame:
    """The models asked for, with their place in the order asked; unknown ones drop out."""
    asked = spark.createDataFrame([("Supplier#000000003", 1), ("none", 2), ("Supplier#000000001", 3)], "name string, ordinal long")
    return asked.join(table(spark, d, "supplier").select(F.col("s_name").alias("name"), "s_acctbal"), "name").select("name", "ordinal", "s_acctbal")


@queries.add(
    "side_means",
    f"""WITH {BATTLES}, f AS (SELECT 'm' || (user_id % 8) AS model, avg(value) AS x FROM events GROUP BY 1)
SELECT judge, count(*) AS n, round(avg(a.x), 9) AS winners, round(avg(c.x), 9) AS losers FROM w JOIN f a ON winner = a.model JOIN f c ON loser = c.model GROUP BY 1""",
)
def side_means(spark: SparkSession, d: str) -> DataFrame:
    """A feature's mean on the winning and on the losing side, by judge."""
    f = table(spark, d, "events").groupBy(F.concat(F.lit("m"), (F.col("user_id") % 8).cast("string")).alias("winner")).agg(F.avg("value").alias("x"))
    own = battles(spark, d).join(f, "winner").join(f.select(F.col("winner").alias("loser"), F.col("x").alias("y")), "loser")
    return own.groupBy("judge").agg(F.count("*").alias("n"), F.round(F.avg("x"), 9).alias("winners"), F.round(F.avg("y"), 9).alias("losers"))


@queries.add(
    "slot_layouts",
    """WITH s AS (SELECT label, vec_id % 3 AS slot, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE NOT (label % 4 = 1 AND vec_id % 3 = 2)), m AS (SELECT label, slot, i, avg(v) AS m FROM s GROUP BY 1, 2, 3),
c AS (SELECT slot, i, avg(m) AS c FROM m GROUP BY 1, 2), g AS (SELECT label, c.slot, c.i, coalesce(m.m, c) AS v, m.m IS NOT NULL AS own FROM (SELECT DISTINCT label FROM m) CROSS JOIN c LEFT JOIN m USING (label, slot, i))
SELECT label, bool_and(own) AS all_slots, count(*) AS n_concat, round(sum(v), 6) AS concat_sum, round(sqrt(sum(v * v)), 6) AS concat_norm FROM g GROUP BY 1""",
)
def slot_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Vectors pooled by slot and concatenated; a slot that a model lacks takes the slot's centroid. One row for each
    element until the last step, so that no vector table is gathered."""
    e = table(spark, d, "embeddings").where("not (label % 4 = 1 and vec_id % 3 = 2)").select("label", (F.col("vec_id") % 3).alias("slot"), F.posexplode("embedding").alias("i", "v"))
    m = e.groupBy("label", "slot", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    c = m.groupBy("slot", "i").agg(F.avg("m").alias("c"))
    every = m.select("label").distinct().join(c)  # labels by slots by dimensions: the layout itself
    g = every.join(m, ["label", "slot", "i"], "left").select("label", F.coalesce("m", "c").alias("v"), F.col("m").isNotNull().alias("own"))
    return g.groupBy("label").agg(F.min("own").alias("all_slots"), F.count("*").alias("n_concat"), F.round(F.sum("v"), 6).alias("concat_sum"), F.round(F.sqrt(F.sum(F.col("v") * F.col("v"))), 6).alias("concat_norm"))


@queries.add("ranked_positive", "SELECT user_id, round(total, 6) AS total, row_number() OVER (ORDER BY round(total, 6) DESC, user_id) AS place FROM (SELECT user_id, sum(value - 50) AS total FROM events GROUP BY 1) WHERE total > 0")
def ranked_positive(spark: SparkSession, d: str) -> DataFrame:
    """Only positive scores are ranked."""
    t = table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(F.col("value") - 50), 6).alias("total")).where("total > 0")
    return R.ranked(t, [F.col("user_id")], "place", 16, "total").select("user_id", "total", "place")
