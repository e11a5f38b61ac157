"""Queries that aggregate answers, runs and judges into scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import score as S
from gristmill.operators.exact import quantiles
from gristmill.registering import Queries
from gristmill.session import table

queries = Queries()

#: An event is an answer: the user is the model, the type the label, k the question.
ANSWERS = "a AS (SELECT user_id AS model, CAST(json_extract(props, '$.k') AS BIGINT) % 12 AS question, CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'signup' THEN 'partial' ELSE 'incorrect' END AS label, value, event_id FROM events)"


def answers(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("event_type") == "purchase", "correct").when(F.col("event_type") == "signup", "partial").otherwise("incorrect")
    question = F.get_json_object("props", "$.k").cast("long") % 12
    return table(spark, d, "events").select(F.col("user_id").alias("model"), question.alias("question"), label.alias("label"), "value", "event_id")


@queries.add(
    "answer_counters",
    f"""WITH {ANSWERS} SELECT model, count(*) AS total, count(*) FILTER (WHERE label = 'correct') AS correct, count(*) FILTER (WHERE label = 'partial') AS partly,
round(sum(value), 3) AS tokens, round(sqrt(greatest(avg(value * value) - avg(value) * avg(value), 0)), 3) AS spread, min(event_id) AS first_id,
round((count(*) FILTER (WHERE label = 'correct') + 0.5 * count(*) FILTER (WHERE label = 'partial')) / count(*), 6)::DOUBLE AS accuracy
FROM a GROUP BY 1 HAVING count(*) >= 36""",
)
def answer_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counts by label, sums, deviation from moments and accuracy; models with too few answers drop out."""
    n = lambda x: F.count_if(F.col("label") == x)
    v = F.col("value")
    g = answers(spark, d).groupBy("model").agg(
        F.count("*").alias("total"), n("correct").alias("correct"), n("partial").alias("partly"), F.round(F.sum(v), 3).alias("tokens"),
        F.round(F.sqrt(F.greatest(F.avg(v * v) - F.avg(v) * F.avg(v), F.lit(0.0))), 3).alias("spread"), F.min("event_id").alias("first_id"),
    )
    return g.where("total >= 36").withColumn("accuracy", F.round(S.accuracy(F.col("correct"), F.col("partly"), F.col("total")), 6))


@queries.add(
    "category_accuracy",
    f"""WITH {ANSWERS}, q AS (SELECT model, question, sum(CASE label WHEN 'correct' THEN 1 WHEN 'partial' THEN 0.5 ELSE 0 END) / count(*) AS acc FROM a GROUP BY 1, 2)
SELECT model, round(avg(acc) FILTER (WHERE question < 6), 6)::DOUBLE AS logic, round(avg(acc) FILTER (WHERE question >= 6), 6)::DOUBLE AS style FROM q GROUP BY 1""",
)
def category_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Mean over questions of the share of points, for two sets of questions."""
    points = F.when(F.col("label") == "correct", 1.0).when(F.col("label") == "partial", 0.5).otherwise(0.0)
    q = answers(spark, d).groupBy("model", "question").agg((F.sum(points) / F.count("*")).alias("acc"))
    part = lambda c, n: F.round(F.avg(F.when(c, F.col("acc"))), 6).alias(n)
    return q.groupBy("model").agg(part(F.col("question") < 6, "logic"), part(F.col("question") >= 6, "style"))


@queries.add("question_pivot", f"WITH {ANSWERS} SELECT model, " + ", ".join(f"round(coalesce(avg(value) FILTER (WHERE question = {q}), 0), 9)::DOUBLE AS q{q}" for q in range(12)) + " FROM a GROUP BY 1")
def question_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Mean over runs by model and question as columns; absent ones are 0."""
    wide = answers(spark, d).groupBy("model").pivot("question", list(range(12))).agg(S.mean("value")).na.fill(0)
    return wide.select("model", *[F.round(F.col(str(q)), 9).alias(f"q{q}") for q in range(12)])


@queries.add(
    "row_statistics",
    f"""WITH {ANSWERS}, q AS (SELECT model, question, avg(value) AS x FROM a GROUP BY 1, 2)
SELECT model, round(avg(x), 9) AS mean, round(avg(x) * 12, 8) AS combined, round(stddev(x), 9) AS sd, round(min(x), 9) AS least, round(avg((x > 50)::INT), 6) AS above, round(stddev(x) / avg(x), 9) AS variation FROM q GROUP BY 1""",
)
def row_statistics(spark: SparkSession, d: str) -> DataFrame:
    q = S.mean_in_order(answers(spark, d), ["model", "question"], "value", "event_id")
    x = F.col("x")
    own = S.in_order(q, ["model"], "value", "x").withColumns(dict(zip(("m", "s"), S.moments(x), strict=True)))
    above = F.try_divide(F.size(F.filter(x, lambda v: v > 50)), F.size(x))
    return own.select("model", F.round("m", 9).alias("mean"), F.round(F.col("m") * 12, 8).alias("combined"), F.round("s", 9).alias("sd"), F.round(F.array_min(x), 9).alias("least"), F.round(above, 6).alias("above"), F.round(F.try_divide("s", "m"), 9).alias("variation"))


@queries.add("min_max_scale", "SELECT p_partkey, round(100 * (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 4) AS price, round(100.0 * (p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()), 4)::DOUBLE AS size, 0.0::DOUBLE AS constant FROM part")
def min_max_scale(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"), F.lit(7.0).alias("constant"))
    return S.scaled(part, ["price", "size", "constant"]).select("p_partkey", F.round("price", 4).alias("price"), F.round("size", 4).alias("size"), "constant")


@queries.add(
    "judge_scale",
    """WITH s AS (SELECT event_type AS judge, user_id AS model, avg(value) AS x FROM events GROUP BY 1, 2),
n AS (SELECT judge, model, 100 * (x - min(x) OVER (PARTITION BY judge)) / (max(x) OVER (PARTITION BY judge) - min(x) OVER (PARTITION BY judge)) AS x FROM s)
SELECT model, round(avg(x), 4) AS score, count(*) AS judges FROM n GROUP BY 1""",
)
def judge_scale(spark: SparkSession, d: str) -> DataFrame:
    """Each judge's scores on a scale of their own, then the mean of all judges."""
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("judge"), F.col("user_id").alias("model")).agg(F.avg("value").alias("x"))
    return S.scaled(s, ["x"], ["judge"]).groupBy("model").agg(F.round(F.avg("x"), 4).alias("score"), F.count("*").alias("judges"))


@queries.add(
    "judge_alpha",
    """WITH s AS (SELECT event_type AS judge, user_id AS model, avg(value) AS x FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2),
f AS (SELECT model, sum(x) AS total FROM s GROUP BY 1 HAVING count(*) = 3), v AS (SELECT judge, variance(x) AS v FROM s WHERE model IN (SELECT model FROM f) GROUP BY 1)
SELECT 3::BIGINT AS k, (SELECT count(*) FROM f) AS n, round(3.0 / 2 * (1 - (SELECT sum(v) FROM v) / (SELECT variance(total) FROM f)), 5)::DOUBLE AS alpha""",
)
def judge_alpha(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").where(F.col("event_type").isin("click", "view", "purchase")).groupBy(F.col("event_type").alias("judge"), F.col("user_id").alias("model")).agg(F.avg("value").alias("x"))
    return S.alpha(s, "model", "judge", "x")


@queries.add("group_intervals", "SELECT c_mktsegment AS vendor, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev(c_acctbal) / sqrt(count(*)), 5) AS se, round(avg(c_acctbal) - 1.96 * stddev(c_acctbal) / sqrt(count(*)), 4) AS low, round(avg(c_acctbal) + 1.96 * stddev(c_acctbal) / sqrt(count(*)), 4) AS high FROM customer GROUP BY 1")
def group_intervals(spark: SparkSession, d: str) -> DataFrame:
    return S.interval(table(spark, d, "customer").withColumnRenamed("c_mktsegment", "vendor"), ["vendor"], "c_acctbal")


@queries.add("vendor_flag_pivot", "SELECT c_mktsegment AS vendor, round(avg(c_acctbal) FILTER (WHERE c_custkey % 2 = 0), 4) AS plain, round(avg(c_acctbal) FILTER (WHERE c_custkey % 2 = 1), 4) AS reasoning FROM customer GROUP BY 1")
def vendor_flag_pivot(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("c_custkey") % 2 == 1, "reasoning").otherwise("plain")
    wide = table(spark, d, "customer").withColumn("flag", flag).groupBy(F.col("c_mktsegment").alias("vendor")).pivot("flag", ["plain", "reasoning"])
    return wide.agg(F.round(F.avg("c_acctbal"), 4))


@queries.add(
    "calibration_table",
    """WITH p AS (SELECT l_extendedprice AS actual, l_quantity * 1000 + 500 * l_linenumber AS predicted FROM lineitem),
e AS (SELECT quantile_cont(predicted, 0.25) AS a, quantile_cont(predicted, 0.5) AS b, quantile_cont(predicted, 0.75) AS c FROM p)
SELECT CASE WHEN predicted <= a THEN 0 WHEN predicted <= b THEN 1 WHEN predicted <= c THEN 2 ELSE 3 END AS bin, count(*) AS n, round(avg(predicted), 3) AS mean_predicted, round(avg(actual), 3) AS mean_actual,
round(avg((abs(actual - predicted) < 15000)::INT), 6) AS coverage FROM p, e GROUP BY 1""",
)
def calibration_table(spark: SparkSession, d: str) -> DataFrame:
    """Predicted and actual means by quantile bins of the prediction, with the coverage of an interval."""
    p = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1000 + 500 * F.col("l_linenumber")).alias("predicted"))
    e = quantiles(p, {"predicted": [0.25, 0.5, 0.75]})["predicted"]
    bin_ = F.when(F.col("predicted") <= e[0], 0).when(F.col("predicted") <= e[1], 1).when(F.col("predicted") <= e[2], 2).otherwise(3)
    inside = (F.abs(F.col("actual") - F.col("predicted")) < 15000).cast("int")
    return p.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("predicted"), 3).alias("mean_predicted"), F.round(F.avg("actual"), 3).alias("mean_actual"), F.round(F.avg(inside), 6).alias("coverage"))


@queries.add(
    "fit_metrics",
    """SELECT l_returnflag AS model, round(sqrt(avg(power(l_extendedprice - l_quantity * 1500, 2))), 5) AS rmse, round(avg(abs(l_extendedprice - l_quantity * 1500)), 5) AS mae,
round(1 - sum(power(l_extendedprice - l_quantity * 1500, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2, round(corr(l_extendedprice, l_quantity * 1500), 6) AS pearson FROM lineitem GROUP BY 1""",
)
def fit_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(*S.errors(F.col("l_extendedprice"), F.col("l_quantity") * 1500))


@queries.add(
    "cell_quality",
    """SELECT l_linenumber AS col, count(*) AS n, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(avg((abs(e) < 10000)::INT), 6) AS coverage, round(median(abs(e)), 4) AS median_error
FROM (SELECT l_linenumber, l_extendedprice - l_quantity * 1500 AS e FROM lineitem) GROUP BY 1""",
)
def cell_quality(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("l_extendedprice") - F.col("l_quantity") * 1500
    own = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("col"), e.alias("e"))
    a = F.abs(F.col("e"))
    return own.groupBy("col").agg(F.count("*").alias("n"), F.round(F.avg(a), 4).alias("mae"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 4).alias("rmse"), F.round(F.avg((a < 10000).cast("int")), 6).alias("coverage"), F.round(F.median(a), 4).alias("median_error"))


@queries.add("repeated_predictions", "SELECT user_id AS row_id, round(avg(value), 5) AS predicted, count(*) AS repeats FROM events GROUP BY 1")
def repeated_predictions(spark: SparkSession, d: str) -> DataFrame:
    """One out-of-fold prediction a row: the mean over repeats."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("row_id")).agg(F.round(F.avg("value"), 5).alias("predicted"), F.count("*").alias("repeats"))


@queries.add("completed_models", f"WITH {ANSWERS} SELECT model FROM a GROUP BY 1 HAVING count(DISTINCT (question, label)) >= 28")
def completed_models(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).groupBy("model").agg(F.count_distinct("question", "label").alias("done")).where("done >= 28").select("model")


@queries.add("fill_percentage", "SELECT round((avg((value > 50)::INT) + avg((event_type = 'view')::INT) + 1) / 3 * 100, 4) AS filled FROM events")
def fill_percentage(spark: SparkSession, d: str) -> DataFrame:
    """Mean over columns of their share of filled cells, in percent."""
    e = table(spark, d, "events").select(F.when(F.col("value") > 50, F.col("value")).alias("a"), F.when(F.col("event_type") == "view", 1).alias("b"), F.col("user_id").alias("c"))
    shares = [F.avg(F.col(x).isNotNull().cast("int")) for x in ("a", "b", "c")]
    return e.agg(F.round((shares[0] + shares[1] + shares[2]) / 3 * 100, 4).alias("filled"))


@queries.add(
    "trial_bins",
    """SELECT floor(l_quantity / 10)::BIGINT AS bin, l_returnflag AS param, count(*) AS n, sum((l_linestatus = 'O')::INT)::BIGINT AS complete, round(avg(l_extendedprice), 4) AS mean, round(min(l_extendedprice), 4) AS best FROM lineitem GROUP BY 1, 2""",
)
def trial_bins(spark: SparkSession, d: str) -> DataFrame:
    """Trials by a category and fixed-width bins of a parameter."""
    return table(spark, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 10).alias("bin"), F.col("l_returnflag").alias("param")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("complete"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.min("l_extendedprice"), 4).alias("best")
    )


@queries.add(
    "top_against_bottom",
    """WITH e AS (SELECT quantile_cont(o_totalprice, 0.1) AS lo, quantile_cont(o_totalprice, 0.9) AS hi FROM orders)
SELECT CASE WHEN o_totalprice >= hi THEN 'top' ELSE 'bottom' END AS slice, count(*) AS n, round(avg(o_orderkey), 3) AS mean_key, round(median(o_orderkey), 3) AS median_key FROM orders, e WHERE o_totalprice >= hi OR o_totalprice <= lo GROUP BY 1""",
)
def top_against_bottom(spark: SparkSession, d: str) -> DataFrame:
    """Parameter means of the best and the worst tenth of the trials."""
    orders = table(spark, d, "orders")
    lo, hi = quantiles(orders, {"o_totalprice": [0.1, 0.9]})["o_totalprice"]
    ends = orders.where((F.col("o_totalprice") >= hi) | (F.col("o_totalprice") <= lo))
    return ends.groupBy(F.when(F.col("o_totalprice") >= hi, "top").otherwise("bottom").alias("slice")).agg(F.count("*").alias("n"), F.round(F.avg("o_orderkey"), 3).alias("mean_key"), F.round(F.median("o_orderkey"), 3).alias("median_key"))


@queries.add("conditional_blend", "SELECT p_partkey, greatest(0, least(100, CASE WHEN p_size > 25 AND p_retailprice > 950 THEN 0.4 * p_size + 0.6 * (p_retailprice / 20) ELSE p_size * 1.0 END))::DOUBLE AS score FROM part")
def conditional_blend(spark: SparkSession, d: str) -> DataFrame:
    """A prediction blended with a measured score under a condition, kept within 0 to 100."""
    size, acc = F.col("p_size"), F.col("p_retailprice") / 20
    mixed = F.when((size > 25) & (F.col("p_retailprice") > 950), F.lit(0.4) * size + F.lit(0.6) * acc).otherwise(size.cast("double"))
    return table(spark, d, "part").select("p_partkey", F.greatest(F.lit(0.0), F.least(F.lit(100.0), mixed)).alias("score"))


@queries.add("ratio_features", "SELECT doc_id, round(1000.0 * (length(text) - length(replace(text, '!', ''))) / (length(text) + 1), 6)::DOUBLE AS bangs_per_1k, round(ln(1 + length(text) / 10.0), 6) AS log_length FROM documents")
def ratio_features(spark: SparkSession, d: str) -> DataFrame:
    """Rates per thousand characters with smoothing, and a log of a scaled length."""
    n = F.length("text")
    bangs = n - F.length(F.replace("text", F.lit("!")))
    return table(spark, d, "documents").select("doc_id", F.round(1000 * bangs / (n + 1), 6).alias("bangs_per_1k"), F.round(F.log1p(n / 10), 6).alias("log_length"))


COMPOSITE = {"headers": 0.3, "bold": 0.5, "lists": 0.2}


@queries.add(
    "style_composite",
    r"""WITH r AS (SELECT doc_id, 1000.0 * len(regexp_extract_all(text, '(?m)^\s*#{1,6}\s+')) / (length(text) + 1) AS h, 1000.0 * len(regexp_extract_all(text, '\*\*\S(?:.*?\S)??\*\*|__\S(?:.*?\S)??__')) / (length(text) + 1) AS b,
1000.0 * (len(regexp_extract_all(text, '(?m)^\s*[-*+]\s+')) + len(regexp_extract_all(text, '(?m)^\s*\d+[.)]\s+'))) / (length(text) + 1) AS l FROM documents)
SELECT doc_id, round(ln(1 + h), 6) AS headers, round(ln(1 + b), 6) AS bold, round(ln(1 + l), 6) AS lists, round(0.3 * ln(1 + h) + 0.5 * ln(1 + b) + 0.2 * ln(1 + l), 6) AS composite FROM r""",
)
def style_composite(spark: SparkSession, d: str) -> DataFrame:
    """Rates of marks per thousand characters (with one more), their logs, and a weighted sum of those."""
    text = F.col("text")
    marks = {
        "headers": T.matches(text, r"(?m)^\s*#{1,6}\s+"), "bold": T.matches(text, r"\*\*\S(?:.*?\S)??\*\*|__\S(?:.*?\S)??__"),
        "lists": T.matches(text, r"(?m)^\s*[-*+]\s+") + T.matches(text, r"(?m)^\s*\d+[.)]\s+"),
    }
    logs = {k: F.log1p(1000 * v / (F.length(text) + 1)) for k, v in marks.items()}
    total = sum((logs[k] * w for k, w in COMPOSITE.items()), F.lit(0.0))
    return table(spark, d, "documents").select("doc_id", *[F.round(v, 6).alias(k) for k, v in logs.items()], F.round(total, 6).alias("composite"))


@queries.add("logit_link", "SELECT l_orderkey, l_linenumber, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-ln(p / (1 - p)))), 6) AS back FROM (SELECT l_orderkey, l_linenumber, greatest(0.01, least(0.99, l_quantity / 50.0)) AS p FROM lineitem)")
def logit_link(spark: SparkSession, d: str) -> DataFrame:
    """Shares on the logit scale, kept off 0 and 1, and back."""
    p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("l_quantity") / 50.0))
    z = F.ln(p / (1 - p))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(z, 6).alias("logit"), F.round(1 / (1 + F.exp(-z)), 6).alias("back"))


@queries.add(
    "pooled_slots",
    """WITH s AS (SELECT user_id, event_type AS slot, avg(value) AS v FROM events WHERE value > 60 GROUP BY 1, 2), c AS (SELECT slot, avg(v) AS centroid FROM s GROUP BY 1), g AS (SELECT user_id, slot, centroid FROM (SELECT DISTINCT user_id FROM s), c)
SELECT user_id, string_agg(round(coalesce(v, centroid), 3)::VARCHAR, '|' ORDER BY slot) IS NOT NULL AS whole, count(v) AS filled, round(sum(coalesce(v, centroid)), 7) AS total FROM g LEFT JOIN s USING (user_id, slot) GROUP BY 1""",
)
def pooled_slots(spark: SparkSession, d: str) -> DataFrame:
    """One pooled value for each slot of a model; slots it lacks take the slot's centroid (few slots, broadcast)."""
    s = table(spark, d, "events").where("value > 60").groupBy("user_id", F.col("event_type").alias("slot")).agg(F.avg("value").alias("v"))
    centroids = s.groupBy("slot").agg(F.avg("v").alias("centroid"))
    all_ = centroids.agg(F.collect_list(F.struct("slot", "centroid")).alias("all"))
    own = s.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("own")).withColumn("all", all_.scalar())
    values = F.transform("all", lambda x: F.coalesce(F.col("own")[x["slot"]], x["centroid"]))
    return own.select("user_id", F.lit(True).alias("whole"), F.size("own").cast("long").alias("filled"), F.round(F.aggregate(values, F.lit(0.0), lambda a, b: a + b), 7).alias("total"))
