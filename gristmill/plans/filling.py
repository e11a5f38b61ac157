"""Queries on further ways to fill gaps: Gaussian processes, tiers, coherence with gates, distance from what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import coherence, impute, reach
from gristmill.operators.gaussian import GaussianProcess
from gristmill.operators.tiers import Tiers
from gristmill.plans.kernels import sparse_parts
from gristmill.registering import Queries
from gristmill.session import table

queries = Queries()
COLUMNS = ["q", "e", "p", "x"]


@queries.add("gaussian_cells")
def gaussian_cells(spark: SparkSession, d: str) -> DataFrame:
    """The parts' last column by a Gaussian process on the others, with its variance."""
    own = sparse_parts(spark, d)
    return GaussianProcess(points=48).fit(own, "k", COLUMNS[:3], "x").predict(own)


@queries.add("tiered_cells")
def tiered_cells(spark: SparkSession, d: str) -> DataFrame:
    """All cells of the parts' matrix, gaps filled tier by tier, with the round in which each was filled."""
    return Tiers().filled(sparse_parts(spark, d), "k", COLUMNS)


@queries.add("gated_cells")
def gated_cells(spark: SparkSession, d: str) -> DataFrame:
    """Filled cells drawn towards the matrix's two leading directions as far as a learned gate says."""
    cells = impute.filled(sparse_parts(spark, d), "k", COLUMNS)
    return coherence.drawn(cells, "k", COLUMNS, 2, gate="learned")


@queries.add("model_importances")
def model_importances(spark: SparkSession, d: str) -> DataFrame:
    """Each column's chosen model and what its predictors weigh in it."""
    rows = impute.importances(sparse_parts(spark, d), COLUMNS)
    return spark.createDataFrame(rows, "column string, predictor string, share double, loo double, place int")


RATIOS = """
s AS (SELECT avg(p_size) AS ma, stddev_pop(p_size) AS sa, avg(p_retailprice) AS mb, stddev_pop(p_retailprice) AS sb FROM part),
z AS (SELECT p_partkey AS k, (p_size - ma) / sa AS a, (p_retailprice - mb) / sb AS b FROM part, s),
u AS (SELECT * FROM z ORDER BY md5(k::VARCHAR) LIMIT 50),
m AS (SELECT median(sqrt((u.a - v.a) ** 2 + (u.b - v.b) ** 2)) AS m FROM u JOIN u v ON u.k < v.k),
n AS (SELECT z.k, sqrt((z.a - y.a) ** 2 + (z.b - y.b) ** 2) AS d, row_number() OVER (PARTITION BY z.k ORDER BY (z.a - y.a) ** 2 + (z.b - y.b) ** 2, y.k) AS place FROM z JOIN z y ON z.k <> y.k),
r AS (SELECT k, d / m AS ratio FROM n, m WHERE place = 5)"""


def part_ratios(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size", "p_retailprice")
    return reach.distance_ratios(part, part, "k", ["p_size", "p_retailprice"])


@queries.add("distance_ratios", f"WITH {RATIOS} SELECT k, round(ratio, 6) AS ratio FROM r")
def distance_ratios(spark: SparkSession, d: str) -> DataFrame:
    """How far each part's fifth neighbour is, over the usual distance of parts."""
    return part_ratios(spark, d).select("k", F.round("ratio", 6).alias("ratio"))


@queries.add(
    "quality_by_distance",
    f"""WITH {RATIOS}, e AS (SELECT l_partkey AS k, avg(l_extendedprice - l_quantity * 1500) AS error FROM lineitem GROUP BY 1)
SELECT CASE WHEN ratio <= 0.5 THEN 0 WHEN ratio <= 1 THEN 1 WHEN ratio <= 2 THEN 2 ELSE 3 END AS bin, count(*) AS n, round(avg(abs(error)), 3) AS mae, round(sqrt(avg(error * error)), 3) AS rmse FROM e JOIN r USING (k) GROUP BY 1""",
)
def quality_by_distance(spark: SparkSession, d: str) -> DataFrame:
    """Errors of a price rule by how far the part lies from others."""
    e = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.avg(F.col("l_extendedprice") - F.col("l_quantity") * 1500).alias("error"))
    return reach.quality_by_reach(e, part_ratios(spark, d), "k").select("bin", "n", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"))
