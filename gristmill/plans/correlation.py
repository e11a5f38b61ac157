"""Queries on correlations between columns and on embedding vectors."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import correlate as K
from gristmill.plans.cleaning import MATRIX, TYPES, user_days
from gristmill.registering import Queries
from gristmill.session import table

queries = Queries()
COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = "pairs AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM m" for a, b in combinations(TYPES, 2)) + ")"
SIDES = "sides AS (SELECT a AS target, b AS proxy, n, r FROM pairs UNION ALL SELECT b, a, n, r FROM pairs)"


@queries.add("pearson_pairs", f"WITH {MATRIX}, {PAIRS} SELECT a, b, n, round(r, 6) AS r FROM pairs")
def pearson_pairs(spark: SparkSession, d: str) -> DataFrame:
    return K.pairs(user_days(spark, d), TYPES).withColumn("r", F.round("r", 6))


RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@queries.add(
    "spearman_pairs",
    f"WITH {MATRIX} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(x, y), 6) AS rho FROM (SELECT {RANK.format(a)} AS x, {RANK.format(b)} AS y FROM m WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in combinations(TYPES, 2)),
)
def spearman_pairs(spark: SparkSession, d: str) -> DataFrame:
    return K.rank_pairs(user_days(spark, d), TYPES).withColumn("rho", F.round("rho", 6))


@queries.add("redundant_pairs", "WITH p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS r FROM lineitem" for a, b in combinations(COLUMNS, 2)) + ") SELECT a, b, n, round(r, 6) AS r FROM p WHERE abs(r) > 0.5")
def redundant_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of columns that say nearly the same."""
    return K.pairs(table(spark, d, "lineitem"), COLUMNS).where("abs(r) > 0.5").withColumn("r", F.round("r", 6))


@queries.add(
    "candidate_ranking",
    f"""WITH {MATRIX}, {PAIRS}, {SIDES} SELECT target, proxy, n, round(score, 5) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, proxy) AS place
FROM (SELECT *, abs(r) * sqrt(n) AS score FROM sides WHERE n >= 10)) WHERE place <= 2""",
)
def candidate_ranking(spark: SparkSession, d: str) -> DataFrame:
    c = K.candidates(K.pairs(user_days(spark, d), TYPES), 10, 2)
    return c.select("target", "proxy", "n", F.round("score", 5).alias("score"), F.col("place").cast("long").alias("place"))


@queries.add(
    "imputation_order",
    f"""WITH {MATRIX}, {PAIRS}, {SIDES}, best AS (SELECT target, max(abs(r)) AS r FROM sides GROUP BY 1),
x AS ("""
    + " UNION ALL ".join(f"SELECT '{t}' AS target, avg(({t} IS NULL)::INT) AS missing FROM m" for t in TYPES)
    + ") SELECT target, round(missing, 6) AS missing, round(missing * (1 - r), 6) AS difficulty FROM x JOIN best USING (target)",
)
def imputation_order(spark: SparkSession, d: str) -> DataFrame:
    """How hard each column is to fill: much of it missing and no close proxy."""
    m = user_days(spark, d)
    best = K.both_ways(K.pairs(m, TYPES)).groupBy("target").agg(F.max(F.abs("r")).alias("r"))
    shares = m.agg(F.array(*[F.struct(F.lit(t).alias("target"), F.avg(F.col(t).isNull().cast("int")).alias("missing")) for t in TYPES]).alias("x")).select(F.inline("x"))
    return shares.join(best, "target").select("target", F.round("missing", 6).alias("missing"), F.round(F.col("missing") * (1 - F.col("r")), 6).alias("difficulty"))


@queries.add(
    "proxy_availability",
    f"WITH {MATRIX}, {PAIRS}, {SIDES}, v AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS target, '{b}' AS proxy, avg(({b} IS NOT NULL)::INT) FILTER (WHERE {a} IS NULL) AS available FROM m" for a in TYPES for b in TYPES if a != b)
    + ") SELECT target, proxy, round(abs(r) * available, 6) AS score FROM sides JOIN v USING (target, proxy) WHERE n >= 20",
)
def proxy_availability(spark: SparkSession, d: str) -> DataFrame:
    """|r| times the share of the target's gaps in which the proxy is there."""
    m = user_days(spark, d)
    cells = [F.struct(F.lit(a).alias("target"), F.lit(b).alias("proxy"), F.avg(F.when(F.col(a).isNull(), F.col(b).isNotNull().cast("int"))).alias("available")) for a in TYPES for b in TYPES if a != b]
    v = m.agg(F.array(*cells).alias("x")).select(F.inline("x"))
    return K.both_ways(K.pairs(m, TYPES)).where("n >= 20").join(v, ["target", "proxy"]).select("target", "proxy", F.round(F.abs("r") * F.col("available"), 6).alias("score"))


@queries.add(
    "log_candidates",
    """SELECT column_name, n, round(skew, 5) AS skew, skew > 2 AND n >= 20 AS take_log FROM (SELECT 'value' AS column_name, count(value) AS n, avg(power((value - m) / s, 3)) AS skew FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
UNION ALL SELECT 'cubed', count(value), avg(power((power(value, 3) - m) / s, 3)) FROM events, (SELECT avg(power(value, 3)) AS m, stddev_pop(power(value, 3)) AS s FROM events))""",
)
def log_candidates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("value", F.pow("value", F.lit(3.0)).alias("cubed"))
    return e.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.skewness(c).alias("skew")) for c in ("value", "cubed")]).alias("x")).select(F.inline("x")).select("column_name", "n", F.round("skew", 5).alias("skew"), ((F.col("skew") > 2) & (F.col("n") >= 20)).alias("take_log"))


@queries.add("bounded_columns", " UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c})::DOUBLE + 0.0 AS lower, max({c})::DOUBLE + 0.0 AS upper, min({c}) >= 0 AND max({c}) <= 100 AS bounded FROM lineitem" for c in COLUMNS))
def bounded_columns(spark: SparkSession, d: str) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column_name"), (F.min(c).cast("double") + 0.0).alias("lower"), (F.max(c).cast("double") + 0.0).alias("upper")) for c in COLUMNS]
    return table(spark, d, "lineitem").agg(F.array(*cells).alias("x")).select(F.inline("x")).withColumn("bounded", (F.col("lower") >= 0) & (F.col("upper") <= 100))


VECTORS = "e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY 1, 2), u AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM c)"


@queries.add("mean_vectors", f"WITH {VECTORS} SELECT label, i::INT AS dim, round(m, 6) AS value FROM u")
def mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    m = K.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    return m.select("label", F.posexplode("embedding").alias("dim", "value")).select("label", "dim", F.round("value", 6).alias("value"))


@queries.add("direction_cosines", f"WITH {VECTORS} SELECT x.label AS left_label, y.label AS right_label, round(sum(x.m * y.m), 6) AS cosine, count(*) FILTER (WHERE sign(x.m) = sign(y.m)) AS same_sign FROM u x JOIN u y ON x.i = y.i AND x.label < y.label GROUP BY 1, 2")
def direction_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Cosine and agreement in sign between the groups' directions (few groups, one vector each)."""
    m = K.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    x, y = m.select(F.col("label").alias("left_label"), F.col("embedding").alias("p")), m.select(F.col("label").alias("right_label"), F.col("embedding").alias("q"))
    same = F.size(F.filter(F.zip_with("p", "q", lambda a, b: F.signum(a) == F.signum(b)), lambda t: t))
    return x.join(y, F.col("left_label") < F.col("right_label")).select("left_label", "right_label", F.round(K.cosine("p", "q"), 6).alias("cosine"), same.cast("long").alias("same_sign"))


@queries.add("nearest_centroid", f"WITH {VECTORS}, s AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v, label AS own FROM embeddings), t AS (SELECT vec_id, own, u.label, sum(v * m) AS score FROM s JOIN u USING (i) GROUP BY 1, 2, 3) SELECT vec_id, arg_max(label, (score, -label)) AS nearest, arg_max(label, (score, -label)) = any_value(own) AS hit FROM t GROUP BY 1")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's group with the most similar direction; group directions are few and go to every task."""
    e = table(spark, d, "embeddings")
    m = K.mean_vectors(e, "label", "embedding").select(F.col("label").alias("near"), F.col("embedding").alias("m"))
    all_ = m.agg(F.sort_array(F.collect_list(F.struct("near", "m"))).alias("all"))  # a vector for each label
    dot = lambda x: F.aggregate(F.zip_with("embedding", x["m"], lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    best = F.array_max(F.transform("all", lambda x: F.struct(dot(x).alias("score"), (-x["near"]).alias("order"))))
    return e.withColumn("all", all_.scalar()).select("vec_id", (-best["order"]).alias("nearest"), (-best["order"] == F.col("label")).alias("hit"))
