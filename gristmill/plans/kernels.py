"""Queries on imputation, prediction, calibration, blending, match choice and dependency graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import bank, factors, graph, impute, match, predict
from gristmill.operators.exact import medians, quantiles
from gristmill.plans.cleaning import MATRIX, TYPES, user_days
from gristmill.registering import Queries
from gristmill.session import table
from gristmill.tables import stored

queries = Queries()


def sparse_parts(spark: SparkSession, d: str) -> DataFrame:
    """A numeric matrix with gaps by rule: mean line values by part, related columns, a fifth of the cells missing.
    It is stored, since fits go over it many times."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("e"), F.avg("l_discount").alias("s"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("p"))
    own = lines.join(part, "k").select("k", "q", "e", "p", (F.col("e") + 300 * F.col("q") + 5000 * F.col("s")).alias("x"))
    gap = lambda c, n: F.when(F.pmod(F.col("k") * 31 + n * 17, F.lit(5)) != 0, F.col(c)).alias(c)
    return stored(own.select("k", *[gap(c, n) for n, c in enumerate(("q", "e", "p", "x"))]), "sparse-parts")


@queries.add(
    "median_fill",
    f"WITH {MATRIX} " + " UNION ALL ".join(f"SELECT entity, '{t}' AS column_name, round(coalesce({t}, (SELECT median({t}) FROM m)), 6) AS value, CASE WHEN {t} IS NULL THEN round((SELECT variance({t}) FROM m), 4) ELSE 0.0::DOUBLE END AS sigma2 FROM m" for t in TYPES),
)
def median_fill(spark: SparkSession, d: str) -> DataFrame:
    """Medians with the column's variance as uncertainty, which is where every other model falls back to."""
    m = user_days(spark, d)
    s, middle = m.agg(*[F.variance(t).alias(t) for t in TYPES]).first(), medians(m, TYPES)
    cells = [F.struct(F.lit(t).alias("column_name"), F.round(F.coalesce(F.col(t), F.lit(middle[t])), 6).alias("value"), F.when(F.col(t).isNull(), F.round(F.lit(s[t]), 4)).otherwise(0.0).alias("sigma2")) for t in TYPES]
    return m.select("entity", F.inline(F.array(*cells)))


@queries.add("impute_cells")
def impute_cells(spark: SparkSession, d: str) -> DataFrame:
    """Each missing cell by the best regression whose predictors its row has."""
    return impute.filled(sparse_parts(spark, d), "k", ["q", "e", "p", "x"])


@queries.add("impute_coherent")
def impute_coherent(spark: SparkSession, d: str) -> DataFrame:
    return impute.coherent(impute.filled(sparse_parts(spark, d), "k", ["q", "e", "p", "x"]), "k", ["q", "e", "p", "x"], 2)


@queries.add("model_bank")
def model_bank(spark: SparkSession, d: str) -> DataFrame:
    """Each missing cell by the model that its column's kind asks for, in two passes."""
    return bank.filled(sparse_parts(spark, d), "k", ["q", "e", "p", "x"], 2)


@queries.add("completed_matrix")
def completed_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Gaps from the best approximation of rank 2."""
    return bank.completed(sparse_parts(spark, d), "k", ["q", "e", "p", "x"], 2, 8)


@queries.add("chained_matrix")
def chained_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Gaps by regressions of each column on all others, five times over."""
    return factors.chained(sparse_parts(spark, d), "k", ["q", "e", "p", "x"], 5)


@queries.add("ridge_baseline")
def ridge_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The best of several ridges by held-out error, all from one pass over the rows."""
    alpha, error, r2 = factors.ridge_cv(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", F.pmod(F.col("l_orderkey"), F.lit(5)), 5, [0.1, 1.0, 10.0, 100.0])
    return spark.createDataFrame([(alpha, error, r2)], "alpha double, rmse double, r2 double")


@queries.add("column_kinds")
def column_kinds(spark: SparkSession, d: str) -> DataFrame:
    return bank.kinds(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"])


@queries.add("partial_correlations")
def partial_correlations(spark: SparkSession, d: str) -> DataFrame:
    return bank.partial_correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@queries.add("impute_trajectory")
def impute_trajectory(spark: SparkSession, d: str) -> DataFrame:
    return impute.trajectory(impute.filled(sparse_parts(spark, d), "k", ["q", "e", "p", "x"]), "k")


@queries.add("impute_quality")
def impute_quality(spark: SparkSession, d: str) -> DataFrame:
    return impute.held_out_errors(sparse_parts(spark, d), "k", ["q", "e", "p", "x"])


def labelled(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("y"))
    return c.join(lines, "k")


@queries.add("local_predictions")
def local_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold predictions by adaptive local ridge on features and PLS components."""
    return predict.out_of_fold(labelled(spark, d), "k", ["a", "b", "q"], "y")


@queries.add("calibrated_intervals")
def calibrated_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with a scale, a 95 % interval and the chance to be above a bar."""
    oof = predict.out_of_fold(labelled(spark, d), "k", ["a", "b", "q"], "y")
    c = predict.calibrated(oof)
    s = c.sigma(F.col("neighbour_sd"))
    half = s * predict.t_quantile(0.975, c.df)
    return oof.select("k", "actual", "predicted", s.alias("sigma"), (F.col("predicted") - half).alias("lower"), (F.col("predicted") + half).alias("upper"), c.above(F.col("predicted"), s, 38000.0).alias("p_above"))


@queries.add("fold_counts", "SELECT ('0x' || substr(md5(c_custkey || ':3'), 1, 8))::BIGINT % 5 AS fold, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1")
def fold_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(predict.folds("c_custkey", 5, 3).alias("fold")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@queries.add(
    "blend_weight",
    """WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS a, 20000 + 700 * l_quantity + 10 * l_linenumber AS b FROM lineitem),
g AS (SELECT w, sqrt(avg(power(y - (w / 20.0 * a + (1 - w / 20.0) * b), 2))) AS rmse FROM p, range(21) t(w) GROUP BY 1)
SELECT arg_min(w, (rmse, w)) / 20.0::DOUBLE AS weight, round(min(rmse), 4) AS rmse FROM g""",
)
def blend_weight(spark: SparkSession, d: str) -> DataFrame:
    """The best weight of two predictions on a grid: one pass, an aggregate for each grid point."""
    p = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("a"), (20000 + 700 * F.col("l_quantity") + 10 * F.col("l_linenumber")).alias("b"))
    at = lambda w: F.col("y") - (F.lit(w / 20) * F.col("a") + F.lit(1 - w / 20) * F.col("b"))
    grid = p.agg(F.array(*[F.struct(F.sqrt(F.avg(at(w) * at(w))).alias("rmse"), F.lit(w / 20).alias("weight")) for w in range(21)]).alias("g"))
    best = F.array_min("g")
    return grid.select(best["weight"].alias("weight"), F.round(best["rmse"], 4).alias("rmse"))


@queries.add(
    "residualised",
    """SELECT event_type, round(regr_slope(value, user_id), 8) AS slope, round(regr_intercept(value, user_id), 5) AS intercept, round(regr_r2(value, user_id), 8) AS r2,
round(sqrt(greatest(var_pop(value) - power(covar_pop(value, user_id), 2) / var_pop(user_id), 0)), 5) AS residual_sd FROM events GROUP BY 1""",
)
def residualised(spark: SparkSession, d: str) -> DataFrame:
    """Ordinary least squares by group, and what is left of the target without it."""
    return table(spark, d, "events").groupBy("event_type").agg(
        F.round(F.regr_slope("value", "user_id"), 8).alias("slope"), F.round(F.regr_intercept("value", "user_id"), 5).alias("intercept"), F.round(F.regr_r2("value", "user_id"), 8).alias("r2"),
        F.round(F.sqrt(F.greatest(F.var_pop("value") - F.pow(F.covar_pop("value", "user_id"), F.lit(2)) / F.var_pop("user_id"), F.lit(0.0))), 5).alias("residual_sd"),
    )


BETA2 = match.BETA2
RATED = "r AS (SELECT s_suppkey AS m, 25 + s_acctbal / 1000 AS mu, 2 + (s_suppkey % 7) AS sigma FROM supplier)"


@queries.add(
    "match_gain",
    f"""WITH {RATED}, p AS (SELECT a.m AS left_id, b.m AS right_id, (a.sigma + b.sigma) * sqrt(2 * {BETA2} / (2 * {BETA2} + a.sigma * a.sigma + b.sigma * b.sigma)) * exp(-power(a.mu - b.mu, 2) / (2 * (2 * {BETA2} + a.sigma * a.sigma + b.sigma * b.sigma))) AS gain
FROM r a JOIN r b ON a.m < b.m) SELECT left_id, right_id, round(gain, 6) AS gain FROM p ORDER BY round(gain, 9) DESC, left_id, right_id LIMIT 40""",
)
def match_gain(spark: SparkSession, d: str) -> DataFrame:
    """The pairs most worth playing, of all: uncertain and close ones first, up to a budget."""
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("m"), (25 + F.col("s_acctbal") / 1000).alias("mu"), (2 + F.col("s_suppkey") % 7).cast("double").alias("sigma"))
    return match.best_pairs(r, "m", 40).withColumn("gain", F.round("gain", 6))


@queries.add(
    "scale_floor",
    """WITH s AS (SELECT user_id, stddev(value) AS sd, avg(value) - 50 AS r FROM events GROUP BY 1), f AS (SELECT quantile_cont(sd, 0.25) AS floor FROM s)
SELECT user_id, round(1.08 * 1.2 * greatest(sd, floor), 5) AS sigma, abs(r) <= 1.96 * 1.08 * 1.2 * greatest(sd, floor) AS covered FROM s, f""",
)
def scale_floor(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id").agg(F.stddev("value").alias("sd"), (F.avg("value") - 50).alias("r"))
    floor = quantiles(s, {"sd": [0.25]})["sd"][0]
    sigma = 1.08 * 1.2 * F.greatest("sd", F.lit(floor))
    return s.select("user_id", F.round(sigma, 5).alias("sigma"), (F.abs("r") <= 1.96 * sigma).alias("covered"))


@queries.add(
    "dependency_depth",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey),
w AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = node WHERE depth < 12)
SELECT node, min(depth)::INT AS depth FROM w GROUP BY 1""",
)
def dependency_depth(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first depth from a root over a dependency graph, a frontier join for each level until none is new."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).where("src != dst").distinct()
    return graph.depths(e, spark.range(1, 2).select(F.col("id").alias("node")))
