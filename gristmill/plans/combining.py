"""Queries that join sources by key: wide matrices, lookups, set operations, pairs and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import combine as C
from gristmill.operators import overlap
from gristmill.registering import Queries
from gristmill.session import table

queries = Queries()


def sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Three tables by customer key: account, orders, events."""
    account = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    events = table(spark, d, "events").groupBy(F.col("user_id").alias("entity")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))
    return {"account": account, "orders": orders, "events": events}


COMBINED = """
WITH a AS (SELECT c_custkey AS entity, c_acctbal AS account_balance, c_mktsegment AS account_segment, true AS pa FROM customer),
o AS (SELECT o_custkey AS entity, count(*) AS orders_n, round(sum(o_totalprice), 2) AS orders_spent, true AS po FROM orders GROUP BY 1),
e AS (SELECT user_id AS entity, count(*) AS events_n, round(avg(value), 4) AS events_mean_value, true AS pe FROM events GROUP BY 1),
w AS (SELECT entity, account_balance, account_segment, coalesce(pa, false) AS in_account, orders_n, orders_spent, coalesce(po, false) AS in_orders,
  events_n, events_mean_value, coalesce(pe, false) AS in_events FROM a FULL OUTER JOIN o USING (entity) FULL OUTER JOIN e USING (entity))
"""


@queries.add(
    "combine_sources",
    COMBINED
    + """SELECT *, round(((account_balance IS NULL)::INT + (account_segment IS NULL)::INT + (orders_n IS NULL)::INT + (orders_spent IS NULL)::INT
  + (events_n IS NULL)::INT + (events_mean_value IS NULL)::INT) / 6.0, 4)::DOUBLE AS missing FROM w
WHERE ((account_balance IS NULL)::INT + (account_segment IS NULL)::INT + (orders_n IS NULL)::INT + (orders_spent IS NULL)::INT
  + (events_n IS NULL)::INT + (events_mean_value IS NULL)::INT) / 6.0 < 0.508""",
)
def combine_sources(spark: SparkSession, d: str) -> DataFrame:
    """Full outer combination with presence flags; rows with half of their cells or more are kept."""
    wide = C.combine(sources(spark, d), "entity")
    values = [c for c in wide.columns if c != "entity" and not c.startswith("in_")]
    return wide.withColumn("missing", F.round(C.missing_share(values), 4)).where(C.missing_share(values) < 0.508)


@queries.add("presence_counts", COMBINED + "SELECT count(*) AS n, sum(in_account::INT)::BIGINT AS account, sum(in_orders::INT)::BIGINT AS orders, sum(in_events::INT)::BIGINT AS events, sum((in_account AND in_orders AND in_events)::INT)::BIGINT AS all_three FROM w")
def presence_counts(spark: SparkSession, d: str) -> DataFrame:
    wide = C.combine(sources(spark, d), "entity")
    n = lambda c: F.sum(c.cast("int"))
    flags = [F.col(f"in_{s}") for s in ("account", "orders", "events")]
    return wide.agg(F.count("*").alias("n"), *[n(f).alias(s) for f, s in zip(flags, ("account", "orders", "events"), strict=True)], n(flags[0] & flags[1] & flags[2]).alias("all_three"))


@queries.add("keep_first", "SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")
    return C.keep_first(own, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@queries.add(
    "duplicate_conflicts",
    """SELECT o_custkey, n_rows, concat_ws(',', CASE WHEN s > 1 THEN 'o_orderstatus' END, CASE WHEN p > 1 THEN 'o_orderpriority' END) AS columns
FROM (SELECT o_custkey, count(*) AS n_rows, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1) WHERE n_rows > 1""",
)
def duplicate_conflicts(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return C.conflicts(own, "o_custkey").withColumn("columns", F.array_join("columns", ","))


@queries.add(
    "mapped_names",
    """WITH m AS (SELECT n_name AS source_name, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE r_name || ':' || n_name END AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 1)
SELECT s_suppkey, trim(coalesce(nullif(canonical, ''), n_name)) AS entity FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN m ON trim(n_name) = source_name""",
)
def mapped_names(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    mapping = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 4 != 1").select(
        F.col("n_name").alias("source_name"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat_ws(":", "r_name", "n_name")).alias("canonical")
    )
    names = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return C.mapped_names(names, "n_name", mapping, "entity").select("s_suppkey", "entity")


@queries.add(
    "lookup_with_default",
    """SELECT e.event_id, coalesce(c_mktsegment, 'Unknown') AS segment, CASE WHEN c_acctbal > 0 THEN 'credit' WHEN c_acctbal <= 0 THEN 'debit' ELSE 'Other' END AS kind
FROM events e LEFT JOIN customer ON e.user_id = c_custkey AND c_custkey % 3 <> 0""",
)
def lookup_with_default(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("user_id"), "c_mktsegment", "c_acctbal")
    kind = F.when(F.col("c_acctbal") > 0, "credit").when(F.col("c_acctbal") <= 0, "debit").otherwise("Other")
    return table(spark, d, "events").join(known, "user_id", "left").select("event_id", F.coalesce("c_mktsegment", F.lit("Unknown")).alias("segment"), kind.alias("kind"))


@queries.add(
    "override_cells",
    """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 2 END AS c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN 'PATCHED' END AS c_mktsegment FROM customer WHERE c_custkey % 4 < 3)
SELECT b.c_custkey, coalesce(n.c_acctbal, b.c_acctbal) AS c_acctbal, coalesce(n.c_mktsegment, b.c_mktsegment) AS c_mktsegment FROM customer b LEFT JOIN n ON b.c_custkey = n.c_custkey""",
)
def override_cells(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = base.where("c_custkey % 4 < 3").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") * 2).alias("c_acctbal"), F.when(F.col("c_custkey") % 5 == 0, "PATCHED").alias("c_mktsegment"))
    return C.overridden(base, new, "c_custkey")


@queries.add("patch_cells", "SELECT p_partkey, CASE WHEN p_brand = (SELECT min(p_brand) FROM part) AND p_size < 5 THEN 99.5 ELSE p_retailprice END AS price, CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size END AS size FROM part")
def patch_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells replaced on a condition: a price where it is missing for one brand, a default for others."""
    part = table(spark, d, "part")
    least = part.agg(F.min("p_brand").alias("b"))
    hit = (F.col("p_brand") == least.scalar()) & (F.col("p_size") < 5)
    return part.select("p_partkey", F.when(hit, 99.5).otherwise(F.col("p_retailprice")).alias("price"), F.when(F.col("p_size") % 10 == 0, 0).otherwise(F.col("p_size")).alias("size"))


@queries.add("inner_scores_costs", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS cost, p_retailprice AS score FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40")
def inner_scores_costs(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("score"))
    return table(spark, d, "lineitem").join(parts, "l_partkey").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost"), "score")


@queries.add(
    "pareto_frontier",
    """SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice >= a.p_retailprice
AND (b.p_size < a.p_size OR b.p_retailprice > a.p_retailprice))""",
)
def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    return C.frontier(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice")


ITEMS = "i AS (SELECT DISTINCT user_id, event_type || '/' || cast(cast(ts AS DATE) AS VARCHAR) AS item FROM events)"


def user_items(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (user_id, item): an item is a kind of event on a day."""
    item = F.concat_ws("/", "event_type", F.to_date("ts").cast("string")).alias("item")
    return table(spark, d, "events").select("user_id", item).where("user_id is not null and item is not null").distinct()


@queries.add(
    "pair_combinations",
    f"""WITH {ITEMS} SELECT a.user_id AS left_id, b.user_id AS right_id, count(*) AS shared FROM i a JOIN i b ON a.item = b.item AND a.user_id < b.user_id
GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def pair_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of users with at least five items in common."""
    return overlap.overlapping(user_items(spark, d), "user_id", "item", 5)


@queries.add(
    "overlap_work",
    f"""WITH {ITEMS}, n AS (SELECT item, count(*) AS n FROM i GROUP BY 1), s AS (SELECT user_id, item, n, row_number() OVER (PARTITION BY user_id ORDER BY n, item) AS k, count(*) OVER (PARTITION BY user_id) AS size FROM i JOIN n USING (item)),
p AS (SELECT item, count(*) AS n FROM s WHERE size >= 5 AND k <= size - 4 GROUP BY 1)
SELECT (SELECT sum(n * (n - 1) / 2) FROM n)::BIGINT AS pairs_of_items, (SELECT sum(n * (n - 1) / 2) FROM p)::BIGINT AS pairs_of_prefixes""",
)
def overlap_work(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs the items would bring together, and how many the prefixes of rare items do."""
    return overlap.work(user_items(spark, d), "user_id", "item", 5)


JUDGES = ("BUILDING", " AUTOMOBILE", "MACHINERY ")


@queries.add(
    "roster_lookup",
    """SELECT c_custkey, c_mktsegment AS judge, CASE trim(c_mktsegment) WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 3 END::BIGINT AS place FROM customer
WHERE trim(c_mktsegment) IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')""",
)
def roster_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the roster by trimmed names, in the order asked for; a name that is not there is an error."""
    roster = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("judge"))
    return C.by_name(roster, "judge", list(JUDGES))


@queries.add("work_list", "SELECT c_custkey, n_nationkey FROM customer JOIN nation ON n_regionkey = c_custkey % 5 WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 25 = n_nationkey)")
def work_list(spark: SparkSession, d: str) -> DataFrame:
    """Combinations that are still to do: candidates without the completed ones."""
    todo = table(spark, d, "customer").select("c_custkey").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("c_custkey") % 5).select("c_custkey", "n_nationkey")
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 25).cast("int").alias("n_nationkey"))
    return todo.join(done, ["c_custkey", "n_nationkey"], "left_anti")


@queries.add("semi_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_filter(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@queries.add("interval_bins", "SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 25 THEN 'mid' WHEN l_quantity < 40 THEN 'high' ELSE 'top' END AS bin, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_price FROM lineitem GROUP BY 1")
def interval_bins(spark: SparkSession, d: str) -> DataFrame:
    edges = [("low", 10.0), ("mid", 25.0), ("high", 40.0)]
    bin_ = F.lit("top")
    for name, upper in reversed(edges):
        bin_ = F.when(F.col("l_quantity") < upper, name).otherwise(bin_)
    return table(spark, d, "lineitem").groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))


@queries.add(
    "attribute_values",
    """WITH p AS (SELECT l_orderkey AS id, 'quantity' AS param, l_quantity AS v, l_linenumber FROM lineitem UNION ALL SELECT l_orderkey, 'discount', l_discount, l_linenumber FROM lineitem)
SELECT o_orderkey, o_totalprice, max(CASE WHEN param = 'quantity' THEN v END) AS quantity, max(CASE WHEN param = 'discount' THEN v END) AS discount
FROM orders JOIN p ON o_orderkey = id AND l_linenumber = 1 GROUP BY 1, 2""",
)
def attribute_values(spark: SparkSession, d: str) -> DataFrame:
    """Rows of (id, parameter, value) joined to their trials and turned into columns."""
    lines = table(spark, d, "lineitem").where("l_linenumber = 1")
    long = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.explode(F.create_map(F.lit("quantity"), "l_quantity", F.lit("discount"), "l_discount")).alias("param", "v"))
    trials = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return trials.join(long, "o_orderkey").groupBy("o_orderkey", "o_totalprice").pivot("param", ["quantity", "discount"]).agg(F.max("v"))


@queries.add("union_all", "SELECT 'c' AS side, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 's', s_nationkey, count(*) FROM supplier GROUP BY 2")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).count().select(F.lit("c").alias("side"), "nation", F.col("count").alias("n"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).count().select(F.lit("s").alias("side"), "nation", F.col("count").alias("n"))
    return c.unionByName(s)


@queries.add("union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@queries.add("intersect_keys", "SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def intersect_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "events").select("user_id"))


@queries.add("except_keys", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))


@queries.add("first_non_empty", "SELECT user_id, arg_min(nullif(event_type, 'view'), event_id) FILTER (WHERE event_type <> 'view') AS first_type FROM events GROUP BY 1")
def first_non_empty(spark: SparkSession, d: str) -> DataFrame:
    """The first value that is not empty ('view' stands for empty here) in the order of the rows."""
    value = F.nullif(F.col("event_type"), F.lit("view"))
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by(value, F.when(value.isNotNull(), F.col("event_id"))).alias("first_type"))


@queries.add(
    "dates_with_priority",
    """SELECT coalesce(a.k, b.k) AS k, coalesce(a.day, b.day) AS day, CASE WHEN a.k IS NOT NULL THEN 'live' ELSE 'legacy' END AS origin
FROM (SELECT o_custkey AS k, max(o_orderdate)::DATE AS day FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1) a FULL OUTER JOIN (SELECT o_custkey AS k, min(o_orderdate)::DATE AS day FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1) b ON a.k = b.k""",
)
def dates_with_priority(spark: SparkSession, d: str) -> DataFrame:
    """One date for each key from two files, of which the live one wins."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"))
    live = o.where("k % 3 != 0").groupBy("k").agg(F.max("day").alias("day")).withColumn("origin", F.lit("live"))
    legacy = o.where("k % 5 != 0").groupBy("k").agg(F.min("day").alias("day")).withColumn("origin", F.lit("legacy"))
    return C.keep_first(live.unionByName(legacy), ["k"], [F.when(F.col("origin") == "live", 0).otherwise(1)])


@queries.add("swap_columns", "SELECT p_partkey, p_name, CASE WHEN n IS NULL THEN p_retailprice ELSE q END AS rating, n IS NOT NULL AS swapped FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, round(avg(l_quantity), 6) AS q FROM lineitem WHERE l_quantity > 20 GROUP BY 1 HAVING count(*) > 15) ON l_partkey = p_partkey")
def swap_columns(spark: SparkSession, d: str) -> DataFrame:
    """A rating column replaced by another table's where that one has enough rows."""
    lines = table(spark, d, "lineitem").where("l_quantity > 20").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("q")).where("n > 15")
    joined = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice").join(lines, "p_partkey", "left")
    return joined.select("p_partkey", "p_name", F.when(F.col("n").isNull(), F.col("p_retailprice")).otherwise(F.col("q")).alias("rating"), F.col("n").isNotNull().alias("swapped"))


@queries.add("suffixed_join", "SELECT a.c_nationkey AS nation, a.mean AS mean_mb, b.mean AS mean_sp, a.mean - b.mean > 0 AS first_higher FROM (SELECT c_nationkey, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey, round(avg(s_acctbal), 4) AS mean FROM supplier GROUP BY 1) b ON c_nationkey = s_nationkey")
def suffixed_join(spark: SparkSession, d: str) -> DataFrame:
    """Two predictions of the same rows side by side, told apart by suffixes."""
    mean = lambda t, p, s: table(spark, d, t).groupBy(F.col(f"{p}_nationkey").alias("nation")).agg(F.round(F.avg(f"{p}_acctbal"), 4).alias(f"mean_{s}"))
    return mean("customer", "c", "mb").join(mean("supplier", "s", "sp"), "nation").withColumn("first_higher", F.col("mean_mb") - F.col("mean_sp") > 0)


@queries.add("attached_features", "SELECT count(*) AS n, count(f) AS complete, round(avg(f), 6) AS mean_feature FROM customer LEFT JOIN (SELECT user_id, avg(value) AS f FROM events WHERE event_type = 'purchase' GROUP BY 1) ON user_id = c_custkey")
def attached_features(spark: SparkSession, d: str) -> DataFrame:
    """Features joined to the base by name, and how many rows got them."""
    f = table(spark, d, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.avg("value").alias("f"))
    return table(spark, d, "customer").join(f, "c_custkey", "left").agg(F.count("*").alias("n"), F.count("f").alias("complete"), F.round(F.avg("f"), 6).alias("mean_feature"))
