"""Queries that diagnose predictions: scale signal, calibration, probability scores, walk-forward and baseline errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.operators import rank as R
from gristmill.operators.correlate import rank_pairs
from gristmill.operators.exact import quantiles
from gristmill.operators.predict import folds
from gristmill.registering import Queries
from gristmill.session import table

queries = Queries()

#: A prediction of an order's price with its scale and error, by arithmetic on the table.
OOF = "o AS (SELECT o_orderkey AS k, o_orderdate AS d, o_totalprice AS y, 150000 + (o_custkey % 100) * 700.0 AS p, 60000 + (o_custkey % 37) * 900.0 AS s FROM orders)"


def oof(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"), F.col("o_totalprice").alias("y"), (150000 + (F.col("o_custkey") % 100) * 700.0).alias("p"), (60000 + (F.col("o_custkey") % 37) * 900.0).alias("s")
    )


AVERAGE_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@queries.add(
    "scale_gate",
    f"""WITH {OOF}, a AS (SELECT *, abs(y - p) AS e FROM o), r AS (SELECT {AVERAGE_RANK.format('s')} AS x, {AVERAGE_RANK.format('e')} AS z FROM a),
t AS (SELECT * FROM a WHERE p >= 200000), q AS (SELECT {AVERAGE_RANK.format('s')} AS x, {AVERAGE_RANK.format('e')} AS z FROM t),
u AS (SELECT e, ntile(10) OVER (ORDER BY s DESC, k) AS tile FROM a)
SELECT round((SELECT corr(x, z) FROM r), 6) AS overall, round((SELECT corr(x, z) FROM q), 6) AS top, (SELECT count(*) FROM t) AS n_top, round((SELECT avg(e) FILTER (WHERE tile = 1) / avg(e) FILTER (WHERE tile = 10) FROM u), 6) AS lift,
round((SELECT regr_slope(ln(e), ln(s)) FROM a WHERE e > 0), 6) AS slope, round((SELECT regr_r2(ln(e), ln(s)) FROM a WHERE e > 0), 8) AS r2""",
)
def scale_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether the local scale tells the size of errors: rank correlation overall and among the top predictions, error
    of the tenth with the greatest scale over that with the least, and the line between their logs."""
    a = oof(spark, d).withColumn("e", F.abs(F.col("y") - F.col("p")))
    rho = lambda df, n: rank_pairs(df.select("s", "e"), ["s", "e"]).select(F.round("rho", 6).alias(n))
    top = a.where("p >= 200000")
    n = a.count()
    k = R.ranked(a.select("k", "s", "e"), [F.col("k")], "place", 64, "s", (), "k")
    first, last = n // 10 + (n % 10 > 0), n // 10
    lift = k.agg(F.round(F.avg(F.when(F.col("place") <= first, F.col("e"))) / F.avg(F.when(F.col("place") > n - last, F.col("e"))), 6).alias("lift"))
    line = a.where("e > 0").agg(F.round(F.regr_slope(F.ln("e"), F.ln("s")), 6).alias("slope"), F.round(F.regr_r2(F.ln("e"), F.ln("s")), 8).alias("r2"))
    one = rho(a, "overall").crossJoin(rho(top, "top")).crossJoin(top.agg(F.count("*").alias("n_top"))).crossJoin(lift).crossJoin(line)  # one row each
    return one


#: Logistic distribution function of a scaled error: a form that any engine has.
PIT = "1 / (1 + exp(-1.702 * (y - p) / s))"


@queries.add(
    "calibration_uniformity",
    f"WITH {OOF}, u AS (SELECT k, round({PIT}, 9) AS u FROM o), r AS (SELECT u, row_number() OVER (ORDER BY u) AS i, count(*) OVER () AS n FROM u) SELECT any_value(n) AS n, round(max(greatest(i / n - u, u - (i - 1) / n)), 6)::DOUBLE AS ks FROM r",
)
def calibration_uniformity(spark: SparkSession, d: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of the probability integral transforms from uniform."""
    o = oof(spark, d)
    u = o.select(F.round(1 / (1 + F.exp(-1.702 * (F.col("y") - F.col("p")) / F.col("s"))), 9).alias("u")).groupBy("u").agg(F.count("*").alias("n"))
    below = R.below(u, "u", "n")
    total = o.count()
    gap = F.greatest((F.col("before") + F.col("n")) / total - F.col("u"), F.col("u") - F.col("before") / total)
    return below.agg(F.lit(total).cast("long").alias("n"), F.round(F.max(gap), 6).alias("ks"))


@queries.add(
    "interval_diagnostics",
    f"""WITH {OOF}, z AS (SELECT *, abs(y - p) / s AS z, {PIT.replace('(y - p)', '(p - 220000)')} AS above, (y > 220000)::INT AS hit FROM o)
SELECT count(*) AS n, round(avg((z <= 0.674)::INT), 6) AS within_50, round(avg((z <= 1.282)::INT), 6) AS within_80, round(avg((z <= 1.96)::INT), 6) AS within_95,
round(avg(power(above - hit, 2)), 6) AS brier, round(-avg(hit * ln(greatest(above, 1e-12)) + (1 - hit) * ln(greatest(1 - above, 1e-12))), 6) AS log_loss, round(avg((z <= 1.96)::INT) FILTER (WHERE p >= 200000), 6) AS top_within_95 FROM z""",
)
def interval_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of three intervals, overall and among the top predictions; Brier score and log-loss of a probability."""
    z = oof(spark, d).withColumn("z", F.abs(F.col("y") - F.col("p")) / F.col("s")).withColumn("above", 1 / (1 + F.exp(-1.702 * (F.col("p") - 220000) / F.col("s")))).withColumn("hit", (F.col("y") > 220000).cast("int"))
    inside = lambda at: (F.col("z") <= at).cast("int")
    a, h = F.col("above"), F.col("hit")
    loss = -F.avg(h * F.ln(F.greatest(a, F.lit(1e-12))) + (1 - h) * F.ln(F.greatest(1 - a, F.lit(1e-12))))
    return z.agg(
        F.count("*").alias("n"), *[F.round(F.avg(inside(at)), 6).alias(f"within_{n}") for n, at in ((50, 0.674), (80, 1.282), (95, 1.96))],
        F.round(F.avg((a - h) * (a - h)), 6).alias("brier"), F.round(loss, 6).alias("log_loss"), F.round(F.avg(F.when(F.col("p") >= 200000, inside(1.96))), 6).alias("top_within_95"),
    )


FOLD = "('0x' || substr(md5({0} || ':3'), 1, 8))::BIGINT % 5"


@queries.add(
    "baseline_errors",
    f"""WITH p AS (SELECT o_orderkey AS k, o_totalprice AS y, (o_custkey % 100)::DOUBLE AS x, {FOLD.format('o_orderkey')} AS fold FROM orders),
s AS (SELECT f AS fold, avg(y) FILTER (WHERE p.fold <> f) AS m, regr_slope(y, x) FILTER (WHERE p.fold <> f) AS b, regr_intercept(y, x) FILTER (WHERE p.fold <> f) AS a FROM p, range(5) t(f) GROUP BY 1),
e AS (SELECT y - m AS em, y - (a + b * x) AS el FROM p JOIN s USING (fold)) SELECT 'mean' AS baseline, round(sqrt(avg(em * em)), 4) AS rmse, round(avg(abs(em)), 4) AS mae FROM e UNION ALL SELECT 'line', round(sqrt(avg(el * el)), 4), round(avg(abs(el)), 4) FROM e""",
)
def baseline_errors(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold errors of the mean and of a line, each fold's baseline from sums over the other folds."""
    p = table(spark, d, "orders").select(F.col("o_totalprice").alias("y"), (F.col("o_custkey") % 100).cast("double").alias("x"), folds("o_orderkey", 5, 3).alias("fold"))
    other = lambda f, c: F.when(F.col("fold") != f, F.col(c))
    fits = p.agg(F.array(*[F.struct(F.lit(f).cast("long").alias("fold"), F.avg(other(f, "y")).alias("m"), F.regr_slope(other(f, "y"), "x").alias("b"), F.regr_intercept(other(f, "y"), "x").alias("a")) for f in range(5)]).alias("all")).select(F.inline("all"))
    e = p.join(fits, "fold").select(F.explode(F.array(F.struct(F.lit("mean").alias("baseline"), (F.col("y") - F.col("m")).alias("e")), F.struct(F.lit("line").alias("baseline"), (F.col("y") - F.col("a") - F.col("b") * F.col("x")).alias("e")))).alias("x")).select("x.*")
    return e.groupBy("baseline").agg(F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 4).alias("rmse"), F.round(F.avg(F.abs("e")), 4).alias("mae"))


@queries.add(
    "walk_forward_line",
    """WITH p AS (SELECT event_id, user_id, ts, value AS y, (event_id % 50)::DOUBLE AS x FROM events),
w AS (SELECT event_id, y, x, count(*) OVER v AS n, avg(y) OVER v AS m, regr_slope(y, x) OVER v AS b, regr_intercept(y, x) OVER v AS a FROM p WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, n AS seen, round(CASE WHEN n >= 10 AND b IS NOT NULL THEN a + b * x ELSE m END, 5) AS predicted FROM w""",
)
def walk_forward_line(spark: SparkSession, d: str) -> DataFrame:
    """Each row predicted by a line through all earlier rows of its group, refitted at every step from running sums;
    by their mean as long as there are few."""
    p = table(spark, d, "events").select("event_id", "user_id", "ts", F.col("value").alias("y"), (F.col("event_id") % 50).cast("double").alias("x"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("*").over(w)
    line = F.regr_intercept("y", "x").over(w) + F.regr_slope("y", "x").over(w) * F.col("x")
    return p.select("event_id", n.alias("seen"), F.round(F.when(n >= 10, F.coalesce(line, F.avg("y").over(w))).otherwise(F.avg("y").over(w)), 5).alias("predicted"))


@queries.add(
    "nested_blend",
    """WITH p AS (SELECT o_orderkey AS k, o_totalprice AS y, 150000 + (o_custkey % 100) * 700.0 AS a, 120000 + (o_orderkey % 100) * 1000.0 AS b FROM orders),
g AS (SELECT k, w, power(y - (w / 20.0 * a + (1 - w / 20.0) * b), 2) AS e FROM p, range(21) t(w)), t AS (SELECT w, sum(e) AS total FROM g GROUP BY 1), l AS (SELECT k, arg_min(w, (round(total - e, 2), w)) AS w FROM g JOIN t USING (w) GROUP BY 1)
SELECT w / 20.0::DOUBLE AS weight, count(*) AS rows_ FROM l GROUP BY 1""",
)
def nested_blend(spark: SparkSession, d: str) -> DataFrame:
    """The best blending weight of all other rows, for each row: a row's own errors are taken off the grid's sums."""
    p = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), (150000 + (F.col("o_custkey") % 100) * 700.0).alias("a"), (120000 + (F.col("o_orderkey") % 100) * 1000.0).alias("b"))
    err = [F.pow(F.col("y") - (w / 20.0 * F.col("a") + (1 - w / 20.0) * F.col("b")), F.lit(2)) for w in range(21)]
    total = p.agg(*[F.sum(e).alias(f"t{w}") for w, e in enumerate(err)]).first()
    best = F.array_min(F.array(*[F.struct(F.round(F.lit(total[f"t{w}"]) - e, 2).alias("e"), F.lit(w / 20.0).alias("w")) for w, e in enumerate(err)]))
    return p.select(best["w"].alias("weight")).groupBy("weight").agg(F.count("*").alias("rows_"))


@queries.add("group_folds", "SELECT c_custkey, ('0x' || substr(md5(c_nationkey || ':' || r), 1, 8))::BIGINT % 5 AS fold, r AS repeat FROM customer, range(2) t(r)")
def group_folds(spark: SparkSession, d: str) -> DataFrame:
    """Folds of two repeats in which a group's rows are never parted."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    out = None
    for r in range(2):
        part = c.select("c_custkey", folds("c_nationkey", 5, r).alias("fold"), F.lit(r).cast("long").alias("repeat"))
        out = part if out is None else out.unionByName(part)
    return out


@queries.add(
    "feature_matrix",
    """WITH f AS (SELECT l_orderkey, avg(l_quantity) / 7 AS f1, avg(l_extendedprice) / 7000 AS f2, avg(l_discount) / 7 AS f3, avg(l_tax) / 7 AS f4, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(f1 * f1, 9) AS f1_squared, round(f2 * f2, 9) AS f2_squared, round(f1 * f2, 9) AS f1xf2, round(f1 * f3, 11) AS f1xf3, round(f3 * f4, 13) AS f3xf4, n AS n_imputed FROM f""",
)
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Factors with their squares, their products and a row's number of parts."""
    f = table(spark, d, "lineitem").groupBy("l_orderkey").agg(*[(F.avg(c) / by).alias(f"f{k + 1}") for k, (c, by) in enumerate((("l_quantity", 7), ("l_extendedprice", 7000), ("l_discount", 7), ("l_tax", 7)))], F.count("*").alias("n_imputed"))
    by = lambda a, b, digits: F.round(F.col(a) * F.col(b), digits)
    return f.select("l_orderkey", by("f1", "f1", 9).alias("f1_squared"), by("f2", "f2", 9).alias("f2_squared"), by("f1", "f2", 9).alias("f1xf2"), by("f1", "f3", 11).alias("f1xf3"), by("f3", "f4", 13).alias("f3xf4"), "n_imputed")


@queries.add(
    "tolerance",
    f"""WITH {OOF}, a AS (SELECT k, s, power(y - p, 2) AS e FROM o), c AS (SELECT s, sqrt(sum(e) OVER (ORDER BY s, k) / row_number() OVER (ORDER BY s, k)) AS rmse FROM a)
SELECT round(max(s) FILTER (WHERE rmse <= 1.02 * (SELECT stddev(y) FROM o)), 4)::DOUBLE AS tolerance, count(*) FILTER (WHERE rmse <= 1.02 * (SELECT stddev(y) FROM o)) AS accepted FROM c""",
)
def tolerance(spark: SparkSession, d: str) -> DataFrame:
    """The widest uncertainty up to which the error of all cells that are no less certain stays within a ratio of the
    column's deviation. Running sums go over distinct uncertainties, range by range, then within each."""
    a = oof(spark, d).select("k", "y", "s", F.pow(F.col("y") - F.col("p"), F.lit(2)).alias("e"))
    bar = 1.02 * a.agg(F.stddev("y")).first()[0]
    sums = a.groupBy("s").agg(F.count("*").alias("n"), F.sum("e").alias("t"))
    before = R.below(sums, "s", "n").select("s", F.col("before").alias("n_before")).join(R.below(sums, "s", "t").select("s", F.col("before").alias("t_before")), "s")
    w = Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    c = a.join(before, "s").select("s", F.sqrt((F.col("t_before") + F.sum("e").over(w)) / (F.col("n_before") + F.row_number().over(w))).alias("rmse")).where(F.col("rmse") <= bar)
    return c.agg(F.round(F.max("s"), 4).alias("tolerance"), F.count("*").alias("accepted"))


@queries.add(
    "probe_projection",
    """WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), d AS (SELECT i, avg(v) FILTER (WHERE label % 2 = 0) - avg(v) FILTER (WHERE label % 2 = 1) AS w FROM e GROUP BY 1),
u AS (SELECT i, w / sqrt(sum(w * w) OVER ()) AS w FROM d), p AS (SELECT vec_id, any_value(label) AS label, sum(v * w) AS x, max(v) AS top FROM e JOIN u USING (i) GROUP BY 1)
SELECT label, count(*) AS n, round(avg(x), 6) AS projection, round(corr(x, top), 5) AS with_top FROM p GROUP BY 1""",
)
def probe_projection(spark: SparkSession, d: str) -> DataFrame:
    """Vectors projected on the unit difference of two groups' means, and how that goes with a feature of theirs."""
    e = table(spark, d, "embeddings")
    m = e.select((F.col("label") % 2).alias("side"), F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(
        (F.avg(F.when(F.col("side") == 0, F.col("v").cast("double"))) - F.avg(F.when(F.col("side") == 1, F.col("v").cast("double")))).alias("w")
    )
    probe = [r["w"] for r in m.orderBy("i").collect()]  # one number a dimension
    size = sum(w * w for w in probe) ** 0.5
    unit = F.array(*[F.lit(w / size) for w in probe])
    x = F.aggregate(F.zip_with("embedding", unit, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    p = e.select("label", x.alias("x"), F.array_max("embedding").cast("double").alias("top"))
    return p.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("projection"), F.round(F.corr("x", "top"), 5).alias("with_top"))


@queries.add(
    "percentile_fill",
    """WITH m AS (SELECT s_suppkey, s_nationkey, s_acctbal, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal * 2 + s_suppkey END AS y FROM supplier), c AS (SELECT s_suppkey, y, cume_dist() OVER (ORDER BY s_acctbal) AS p FROM m),
v AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS i, count(*) OVER () AS n FROM m WHERE y IS NOT NULL) SELECT s_suppkey, round(coalesce(c.y, v.y), 6) AS filled FROM c LEFT JOIN v ON c.y IS NULL AND v.i = floor(p * (v.n - 1) + 1e-9)""",
)
def percentile_fill(spark: SparkSession, d: str) -> DataFrame:
    """A gap takes the target's value at the percentile that its row has in a correlated column: ranks from counted
    ranges on both sides, then a join on the place."""
    m = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal") * 2 + F.col("s_suppkey")).alias("y"))
    counts = m.groupBy("s_acctbal").agg(F.count("*").alias("n"))
    total = m.agg(F.count("*").alias("all"), F.count("y").alias("n")).first()
    share = R.below(counts, "s_acctbal", "n").select("s_acctbal", ((F.col("before") + F.col("n")) / total["all"]).alias("p"))
    gaps = m.where("y is null").join(share, "s_acctbal").select("s_suppkey", F.floor(F.col("p") * (total["n"] - 1) + 1e-9).alias("i"))
    values = R.ranked(m.where("y is not null").select("s_suppkey", "y"), [F.col("s_suppkey")], "place", 32, "y").select(F.col("y").alias("filled"), (total["n"] - F.col("place")).alias("i"))
    return gaps.join(values, "i").select("s_suppkey", F.round("filled", 6).alias("filled")).unionByName(m.where("y is not null").select("s_suppkey", F.round("y", 6).alias("filled")))


@queries.add(
    "log_decisions",
    """WITH c AS (SELECT exp(l_quantity / 8) AS a, power(l_extendedprice, 2) AS b, l_quantity AS q FROM lineitem), s AS (
SELECT 'a' AS column_name, count(a) AS n, (SELECT avg(power((a - m) / s, 3)) FROM c, (SELECT avg(a) AS m, stddev_pop(a) AS s FROM c)) AS skew, abs(corr(a, q)) AS plain, abs(corr(ln(1 + a), q)) AS logged FROM c
UNION ALL SELECT 'b', count(b), (SELECT avg(power((b - m) / s, 3)) FROM c, (SELECT avg(b) AS m, stddev_pop(b) AS s FROM c)), abs(corr(b, q)), abs(corr(ln(1 + b), q)) FROM c)
SELECT column_name, round(skew, 5) AS skew, round(plain, 6) AS plain, round(logged, 6) AS logged, n >= 20 AND skew > 2 AND logged - plain > 0.02 AS take_log FROM s""",
)
def log_decisions(spark: SparkSession, d: str) -> DataFrame:
    """A skewed column becomes its log only if that brings it closer to another column by more than 0.02."""
    c = table(spark, d, "lineitem").select(F.exp(F.col("l_quantity") / 8).alias("a"), F.pow("l_extendedprice", F.lit(2.0)).alias("b"), F.col("l_quantity").alias("q"))
    cells = [F.struct(F.lit(x).alias("column_name"), F.count(x).alias("n"), F.skewness(x).alias("skew"), F.abs(F.corr(x, "q")).alias("plain"), F.abs(F.corr(F.log1p(x), "q")).alias("logged")) for x in ("a", "b")]
    s = c.agg(F.array(*cells).alias("all")).select(F.inline("all"))
    take = (F.col("n") >= 20) & (F.col("skew") > 2) & (F.col("logged") - F.col("plain") > 0.02)
    return s.select("column_name", F.round("skew", 5).alias("skew"), F.round("plain", 6).alias("plain"), F.round("logged", 6).alias("logged"), take.alias("take_log"))


@queries.add(
    "difficulty_tiers",
    """WITH x AS (SELECT l_orderkey % 40 AS column_id, avg((l_quantity > 40)::INT) * (1 - abs(corr(l_quantity, l_extendedprice))) AS d FROM lineitem GROUP BY 1), e AS (SELECT quantile_cont(d, 1 / 3.0) AS a, quantile_cont(d, 2 / 3.0) AS b FROM x)
SELECT column_id, round(d, 7) AS difficulty, CASE WHEN d <= a THEN 1 WHEN d <= b THEN 2 ELSE 3 END AS tier FROM x, e""",
)
def difficulty_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Columns in three tiers by how hard they are to fill: share of gaps times what no proxy explains."""
    x = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 40).alias("column_id")).agg((F.avg((F.col("l_quantity") > 40).cast("int")) * (1 - F.abs(F.corr("l_quantity", "l_extendedprice")))).alias("d"))
    a, b = quantiles(x, {"d": [1 / 3, 2 / 3]})["d"]
    return x.select("column_id", F.round("d", 7).alias("difficulty"), F.when(F.col("d") <= a, 1).when(F.col("d") <= b, 2).otherwise(3).alias("tier"))
