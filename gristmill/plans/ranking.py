"""Queries that rank, take the top, or run over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.operators import drawn
from gristmill.operators import rank as R
from gristmill.registering import Queries
from gristmill.session import table

queries = Queries()


@queries.add("ranks", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_name) AS rank FROM customer")
def ranks(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_name")
    return R.ranked(own, [F.col("c_name")], "rank", on="c_acctbal").select("c_custkey", "rank")


@queries.add(
    "rank_stability",
    """WITH u AS (SELECT s_suppkey, s_acctbal, k, ((s_suppkey * 7919 + k * 104729) % 10007 + 0.5) / 10007 AS u, ((s_suppkey * 15485863 + k * 32452843) % 20011 + 0.5) / 20011 AS v FROM supplier, range(1000) t(k)),
x AS (SELECT s_suppkey, k, s_acctbal + 800 / 3.92 * sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS x FROM u), r AS (SELECT s_suppkey, row_number() OVER (PARTITION BY k ORDER BY x DESC, s_suppkey) AS rank FROM x)
SELECT s_suppkey, floor(median(rank))::BIGINT AS median_rank, floor(quantile_cont(rank, 0.05))::BIGINT AS p5, floor(quantile_cont(rank, 0.95))::BIGINT AS p95 FROM r GROUP BY 1""",
)
def rank_stability(spark: SparkSession, d: str) -> DataFrame:
    """Ranks over 1000 normal draws around each score (an interval of 800 is 3.92 deviations wide): median, 5th and
    95th percentile, cut to whole ranks.

    Draws come from arithmetic on the key, so that any engine repeats them.
    """
    ranks = drawn.ranks(table(spark, d, "supplier"), "s_suppkey", "s_acctbal", 1000, 800 / 3.92)
    cut = lambda p: F.floor(drawn.percentile("ranks", p))
    return ranks.select("s_suppkey", cut(0.5).alias("median_rank"), cut(0.05).alias("p5"), cut(0.95).alias("p95"))


@queries.add("z_scores", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev(p_retailprice) OVER (), 5) AS z FROM part")
def z_scores(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    moments = part.agg(F.avg("p_retailprice").alias("m"), F.stddev("p_retailprice").alias("s"))  # one row
    return part.join(F.broadcast(moments)).select("p_partkey", F.round((F.col("p_retailprice") - F.col("m")) / F.col("s"), 5).alias("z"))


@queries.add("empirical_percentiles", "SELECT s_suppkey, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS share FROM supplier")
def empirical_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The share of a nation's balances that are no greater, from counts of distinct values."""
    own = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    counts = R.shares_below(own, "s_acctbal", ["s_nationkey"])
    size = own.groupBy("s_nationkey").agg(F.count("*").alias("size"))
    met = own.join(counts, ["s_nationkey", "s_acctbal"]).join(size, "s_nationkey")
    return met.select("s_suppkey", F.round((F.col("before") + F.col("n")) / F.col("size"), 6).alias("share"))


@queries.add(
    "walk_forward",
    """SELECT event_id, round(avg(value) OVER w, 9) AS predicted, round(max(value) OVER w, 4) AS leader, count(*) OVER w AS seen FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """The mean of all earlier rows as prediction, with the running leader."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 9).alias("predicted"), F.round(F.max("value").over(w), 4).alias("leader"), F.count("*").over(w).alias("seen"))


@queries.add(
    "cumulative_share",
    """WITH t AS (SELECT p_brand, sum(p_retailprice) AS v FROM part GROUP BY 1), c AS (SELECT p_brand, sum(v) OVER (ORDER BY v DESC, p_brand) / sum(v) OVER () AS share, row_number() OVER (ORDER BY v DESC, p_brand) AS k FROM t)
SELECT min(k) AS components FROM c WHERE share >= 0.8""",
)
def cumulative_share(spark: SparkSession, d: str) -> DataFrame:
    """How many of the largest parts make up four fifths (over few brands, so that one ordered window will do)."""
    t = table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("v"))
    order = Window.orderBy(F.desc("v"), "p_brand")
    share = F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("v").over(Window.partitionBy())
    return t.select(share.alias("share"), F.row_number().over(order).cast("long").alias("k")).where("share >= 0.8").agg(F.min("k").alias("components"))


@queries.add(
    "decile_lift",
    """WITH r AS (SELECT l_shipdate, l_extendedprice, ntile(10) OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS t, l_returnflag FROM lineitem)
SELECT l_returnflag, round(avg(l_extendedprice) FILTER (WHERE t = 1) / avg(l_extendedprice), 5) AS top_lift, round(avg(l_extendedprice) FILTER (WHERE t = 10) / avg(l_extendedprice), 5) AS bottom_lift FROM r GROUP BY 1""",
)
def decile_lift(spark: SparkSession, d: str) -> DataFrame:
    """Mean price of the first and the last tenth by quantity over that of all. Tenths come from row numbers that are
    counted range by range; the first n % 10 of them have a row more."""
    own = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_orderkey", "l_linenumber", "l_extendedprice")
    sizes = own.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    r = R.ranked(own, [F.col("l_orderkey"), F.col("l_linenumber")], "k", 64, "l_quantity", ["l_returnflag"], "l_orderkey").join(sizes, "l_returnflag")
    q, more = F.floor(F.col("n") / 10), F.col("n") % 10
    long_ = more * (q + 1)
    t = F.when(F.col("k") <= long_, F.ceil(F.col("k") / (q + 1))).otherwise(more + F.ceil((F.col("k") - long_) / q))
    r = r.withColumn("t", t)
    part = lambda k: F.round(F.avg(F.when(F.col("t") == k, F.col("l_extendedprice"))) / F.avg("l_extendedprice"), 5)
    return r.groupBy("l_returnflag").agg(part(1).alias("top_lift"), part(10).alias("bottom_lift"))


RANKS = "rank() OVER (PARTITION BY s_nationkey ORDER BY {0}) + (count(*) OVER (PARTITION BY s_nationkey, {0}) - 1) / 2.0"


@queries.add("spearman", f"WITH r AS (SELECT s_nationkey, {RANKS.format('s_acctbal')} AS a, {RANKS.format('s_suppkey')} AS b FROM supplier) SELECT s_nationkey, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1 HAVING count(*) > 2")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    r = R.average_ranks(table(spark, d, "supplier").select("s_nationkey", "s_acctbal", "s_suppkey"), ["s_acctbal", "s_suppkey"], ["s_nationkey"])
    return r.groupBy("s_nationkey").agg(F.round(F.corr("rank_s_acctbal", "rank_s_suppkey"), 6).alias("rho"), F.count("*").alias("n")).where("n > 2")


@queries.add("previous_value", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def previous_value(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))


@queries.add("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(25)


@queries.add("bottom_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def bottom_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(25)


@queries.add("top_of_group", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def top_of_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"), F.max("o_totalprice").alias("o_totalprice"))


@queries.add("top_k_of_group", "SELECT c_nationkey, c_custkey, k FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3")
def top_k_of_group(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", k.cast("long").alias("k")).where("k <= 3")


@queries.add("multi_key_order", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_nationkey DESC, c_name LIMIT 50")
def multi_key_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").orderBy(F.desc("c_acctbal"), F.desc("c_nationkey"), "c_name").select("c_custkey", "c_name").limit(50)


@queries.add("seeded_sample", "SELECT event_id, value FROM events ORDER BY md5(event_id || ':17'), event_id LIMIT 200")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of fixed size that any engine draws alike: the order of a hash of the key and a seed."""
    key = F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":17")))
    return table(spark, d, "events").orderBy(key, "event_id").select("event_id", "value").limit(200)
