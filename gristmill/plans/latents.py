"""Queries on latent models, walk-forward prediction and exact neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import latent, walk
from gristmill.operators.metric import MetricIndex
from gristmill.plans.kernels import sparse_parts
from gristmill.registering import Queries
from gristmill.session import table

queries = Queries()
FEATURES = ["q", "e", "p"]


def matrix(spark: SparkSession, d: str) -> latent.Matrix:
    return latent.Matrix.of(sparse_parts(spark, d), "k", FEATURES, "x")


@queries.add("supervised_factors")
def supervised_factors(spark: SparkSession, d: str) -> DataFrame:
    """The parts' matrix and its target as products of two factors, by alternating least squares."""
    m = matrix(spark, d)
    return latent.Factors(rank=2, rounds=40).fit(m).predict(m)


@queries.add("factor_losses")
def factor_losses(spark: SparkSession, d: str) -> DataFrame:
    """What the factors' objective comes to, round by round."""
    m = matrix(spark, d)
    losses = latent.Factors(rank=2, rounds=40).fit(m).losses
    m.drop()
    return spark.createDataFrame([(k + 1, v) for k, v in enumerate(losses)], "round int, loss double")


@queries.add("latent_traits")
def latent_traits(spark: SparkSession, d: str) -> DataFrame:
    """Traits of the parts under loadings that are drawn to the mean of their family, with what is left unsure."""
    m = matrix(spark, d)
    return latent.Traits(rank=2, rounds=30).fit(m, [[0], [1, 2]]).predict(m)


def held_out(spark: SparkSession, d: str, inductive: bool) -> DataFrame:
    return latent.cross_validated(sparse_parts(spark, d), "k", FEATURES, "x", lambda: latent.Factors(rank=2, shrink=1.0, rounds=15), 3, inductive)


@queries.add("latent_validation")
def latent_validation(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the factors where rows were there without their targets, and where they were not there at all."""
    e = F.col("actual") - F.col("predicted")
    parts = [held_out(spark, d, inductive).select(F.lit(name).alias("kind"), e.alias("e")) for name, inductive in (("transductive", False), ("inductive", True))]
    return parts[0].unionByName(parts[1]).groupBy("kind").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"))


@queries.add("item_response")
def item_response(spark: SparkSession, d: str) -> DataFrame:
    """Abilities of the parts and their square, from columns scaled to 0 and 1 as items of a logistic response."""
    rows = latent.unit_range(sparse_parts(spark, d), "k", [*FEATURES, "x"])
    rows = latent.stored(rows, "unit-range")
    return latent.ability_features(rows, "k", latent.ItemResponse(rank=1, rounds=30).fit(rows, 4))


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    return table(spark, d, "orders").join(lines, "o_orderkey")


WALK = """
f AS (
  SELECT o_orderkey, o_orderdate AS t, c::DOUBLE AS x0, q::DOUBLE AS x1, o_totalprice::DOUBLE AS y
  FROM orders JOIN (SELECT l_orderkey, count(*) AS c, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
d AS (
  SELECT t, count(*) AS n, sum(x0) AS a, sum(x1) AS b, sum(y) AS y, sum(x0 * x0) AS aa, sum(x0 * x1) AS ab, sum(x1 * x1) AS bb,
    sum(x0 * y) AS ay, sum(x1 * y) AS b_y FROM f GROUP BY 1),
p AS (
  SELECT t, (sum(n) OVER w)::DOUBLE AS n, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(y) OVER w AS y, sum(aa) OVER w AS aa,
    sum(ab) OVER w AS ab, sum(bb) OVER w AS bb, sum(ay) OVER w AS ay, sum(b_y) OVER w AS b_y
  FROM d WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (
  SELECT t, n, a / n AS ma, b / n AS mb, y / n AS my, sqrt(aa / n - (a / n) ** 2) AS sa, sqrt(bb / n - (b / n) ** 2) AS sb,
    ab / n - a * b / n / n AS cab, ay / n - a * y / n / n AS cay, b_y / n - b * y / n / n AS cby
  FROM p WHERE n >= (SELECT floor(0.8 * count(*)) FROM f)),
w AS (
  SELECT *, n * cab / (sa * sb) AS nr, n * cay / sa AS ra, n * cby / sb AS rb, n + 1.0 AS g FROM m),
s AS (
  SELECT o_orderkey, w.n::BIGINT AS n_train, f.y AS actual,
    my + (x0 - ma) / sa * (g * ra - nr * rb) / (g * g - nr * nr) + (x1 - mb) / sb * (g * rb - nr * ra) / (g * g - nr * nr) AS predicted
  FROM f JOIN w USING (t))"""


def honest(spark: SparkSession, d: str) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01"))
    return walk.walk_forward(order_lines(spark, d), "o_orderkey", days, ["lines", "quantity"], "o_totalprice")


@queries.add("honest_walk_forward", f"WITH {WALK} SELECT o_orderkey, n_train, round(actual, 2) AS actual, round(predicted, 2) AS predicted FROM s")
def honest_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """The newest fifth of the orders' prices, each by a ridge on all orders of earlier days."""
    return honest(spark, d).select("o_orderkey", "n_train", F.round("actual", 2).alias("actual"), F.round("predicted", 2).alias("predicted"))


@queries.add(
    "walk_forward_errors",
    f"""WITH {WALK} SELECT count(*) AS n, round(sqrt(avg((actual - predicted) ** 2)), 3) AS rmse, round(avg(abs(actual - predicted)), 3) AS mae,
round(1 - avg((actual - predicted) ** 2) / var_pop(actual), 6) AS r2, round(corr(actual, predicted), 6) AS r FROM s""",
)
def walk_forward_errors(spark: SparkSession, d: str) -> DataFrame:
    e = walk.walk_errors(honest(spark, d))
    return e.select("n", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), F.round("r2", 6).alias("r2"), F.round("r", 6).alias("r"))


@queries.add("neighbour_visits")
def neighbour_visits(spark: SparkSession, d: str) -> DataFrame:
    """How many of the partitions of all vectors each query had to visit for its five nearest."""
    e = table(spark, d, "embeddings")
    return MetricIndex(e, "vec_id", "embedding").nearest(e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)[1]
