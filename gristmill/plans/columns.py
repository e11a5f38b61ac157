"""Queries on column and name rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import columns as C
from gristmill.operators.combine import missing_share
from gristmill.plans.cleaning import MATRIX, MISSING, TYPES, user_days
from gristmill.registering import Queries
from gristmill.session import table

queries = Queries()


@queries.add("column_whitelist", "SELECT p_partkey, p_brand, 1::BIGINT AS n_missing FROM part")
def column_whitelist(spark: SparkSession, d: str) -> DataFrame:
    """The wanted columns that there are; how many are missing is said in each row."""
    out, missing = C.whitelisted(table(spark, d, "part"), ["p_partkey", "p_colour", "p_brand"])
    return out.withColumn("n_missing", F.lit(len(missing)).cast("long"))


@queries.add("source_rules", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS score FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_nationkey IS NOT NULL AND c_name NOT IN ('Customer#000000002', 'Customer#000000005')")
def source_rules(spark: SparkSession, d: str) -> DataFrame:
    """A source's own renaming, row filter (whose column then goes) and blacklist of rows."""
    own = table(spark, d, "customer").withColumnsRenamed({"c_custkey": "id", "c_name": "name", "c_acctbal": "score"})
    return own.where((F.col("c_mktsegment") != "MACHINERY") & F.col("c_nationkey").isNotNull() & ~F.col("name").isin("Customer#000000002", "Customer#000000005")).select("id", "name", "score")


@queries.add("name_column", "SELECT s_name AS model, s_suppkey FROM supplier")
def name_column(spark: SparkSession, d: str) -> DataFrame:
    """Names from the first candidate column that has any: the first here is empty throughout."""
    own = table(spark, d, "supplier").withColumn("Model Name", F.lit(None).cast("string"))
    return own.select(F.col(f"`{C.name_column(own, ['Model Name', 'absent', 's_name', 's_phone'])}`").alias("model"), "s_suppkey")


@queries.add(
    "analysis_columns",
    "SELECT unnest(['l_discount', 'l_extendedprice', 'l_partkey', 'l_quantity', 'l_tax']) AS column_name, unnest([true, true, false, true, true]) AS feature",
)
def analysis_columns(spark: SparkSession, d: str) -> DataFrame:
    """Numeric columns without those whose names say key or number (one is exempt), and whether each is a feature."""
    lines = table(spark, d, "lineitem")
    kept = C.numeric_columns(lines, ["key", "number"], exempt=["l_partkey"])
    features = C.without_families(kept, ["l_part"], ["l_orderkey"])
    return spark.createDataFrame([(c, c in features) for c in sorted(kept)], "column_name string, feature boolean")


@queries.add("prefix_coverage", f"WITH {MATRIX} SELECT entity, round(((click IS NOT NULL)::INT + (purchase IS NOT NULL)::INT) / 2.0, 4)::DOUBLE AS covered FROM m WHERE ((click IS NOT NULL)::INT + (purchase IS NOT NULL)::INT) / 2.0 >= 0.25")
def prefix_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Rows with at least a quarter of the public columns, which a prefix tells from the others."""
    named = user_days(spark, d).withColumnsRenamed({"click": "pub_click", "purchase": "pub_purchase", "signup": "own_signup", "view": "own_view"})
    public, _ = C.split_by_prefix([c for c in named.columns if c != "entity"], ["pub_"])
    covered = 1 - missing_share(public)
    return named.where(covered >= 0.25).select("entity", F.round(covered, 4).alias("covered"))


@queries.add("drop_constant_columns", f"WITH {MATRIX} SELECT entity, click, purchase, signup, view FROM m WHERE {MISSING} < 0.508")
def drop_constant_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns that do not vary on the rows that are left go: two are put in that are constant or nearly empty."""
    dense = user_days(spark, d).where(missing_share(TYPES) < 0.508).withColumn("same", F.lit(3.0)).withColumn("empty", F.lit(None).cast("double"))
    return dense.select("entity", *C.varying(dense, [*TYPES, "same", "empty"]))


@queries.add(
    "population_variance_rule",
    """SELECT 'tiny' AS column_name, true AS is_low UNION ALL SELECT 'l_quantity', false UNION ALL SELECT 'single', true UNION ALL SELECT 'flag', max(n) / sum(n) >= 0.7 OR sum(n) - max(n) < 2 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_linenumber = 1)""",
)
def population_variance_rule(spark: SparkSession, d: str) -> DataFrame:
    """Low variance by all four rules: one value at most, a population deviation below 1e-8, a value with at least 0.7
    of the rows, fewer than two rows besides it."""
    lines = table(spark, d, "lineitem").select("l_quantity", (5 + F.col("l_linenumber") * 1e-10).alias("tiny"), F.when(F.col("l_linenumber") < 0, 1.0).alias("single"), (F.col("l_linenumber") == 1).cast("double").alias("flag"))
    cells = lines.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in lines.columns])))
    n = cells.groupBy("column_name", "v").agg(F.count("*").alias("n")).groupBy("column_name").agg(
        F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("top"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("n"),
    )
    sd = cells.groupBy("column_name").agg(F.stddev_pop("v").alias("sd"))
    low = (F.col("n") <= 1) | (F.col("sd") < 1e-8) | (F.col("top") / F.col("n") >= 0.7) | (F.col("n") - F.col("top") < 2)
    return n.join(sd, "column_name").select("column_name", F.coalesce(low, F.lit(True)).alias("is_low"))


@queries.add("suite_prefixes", "SELECT p_type AS column_name, CASE WHEN starts_with(p_type, 'STANDARD') THEN 'standard' WHEN starts_with(p_type, 'SMALL') THEN 'small' WHEN starts_with(p_type, 'ECONOMY') THEN 'economy' ELSE 'other' END AS suite, count(*) AS n FROM part GROUP BY 1, 2")
def suite_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """The suite that a column belongs to, by the first of the ordered prefixes."""
    named = table(spark, d, "part").groupBy(F.col("p_type").alias("column_name")).agg(F.count("*").alias("n"))
    return named.select("column_name", C.first_prefix(F.col("column_name"), ["standard", "small", "economy"]).alias("suite"), "n")


@queries.add("brands", "SELECT CASE WHEN contains(lower(p_type), 'standard') THEN 'Standard' WHEN contains(lower(p_type), 'promo') THEN 'Promo' ELSE 'Other' END AS brand, count(*) AS n, min(p_name) AS first_name FROM part GROUP BY 1")
def brands(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").select(C.first_part(F.col("p_type"), {"standard": "Standard", "promo": "Promo"}).alias("brand"), "p_name")
    return own.groupBy("brand").agg(F.count("*").alias("n"), F.min("p_name").alias("first_name"))


@queries.add("interaction_features", "SELECT s_suppkey, round(s_acctbal * s_nationkey, 4) AS product, round(s_acctbal * s_acctbal, 4) AS square, s_acctbal AS plain FROM supplier")
def interaction_features(spark: SparkSession, d: str) -> DataFrame:
    """Features read from their names: products, squares and plain columns."""
    out = {}
    for name in ("s_acctbal*s_nationkey", "s_acctbal^2", "s_acctbal"):
        parts, kind = C.interaction(name)
        x = F.col(parts[0])
        out[kind] = {"product": F.round(x * F.col(parts[-1]), 4), "square": F.round(x * x, 4), "plain": x}[kind]
    return table(spark, d, "supplier").select("s_suppkey", *[c.alias(k) for k, c in out.items()])


@queries.add("factor_products", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 4) AS f1xf2, round(l_quantity * l_discount, 6) AS f1xf3, round(l_quantity * l_tax, 6) AS f1xf4, round(l_extendedprice * l_discount, 6) AS f2xf3, round(l_extendedprice * l_tax, 6) AS f2xf4, round(l_discount * l_tax, 8) AS f3xf4 FROM lineitem")
def factor_products(spark: SparkSession, d: str) -> DataFrame:
    """All products of two of the first four factors."""
    f = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    digits = {("l_quantity", "l_extendedprice"): 4, ("l_discount", "l_tax"): 8}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(F.col(a) * F.col(b), digits.get((a, b), 6)).alias(f"f{i + 1}xf{j + 1}") for i, a in enumerate(f) for j, b in enumerate(f) if i < j])


@queries.add("last_scores", "SELECT lower(event_type) AS name, user_id, arg_max(value, (ts, event_id)) AS score, count(*) AS seen FROM events GROUP BY 1, 2")
def last_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores by name in any case, the last of repeated ones; what is no number drops out before."""
    raw = table(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.initcap("event_type")).alias("Name"), "user_id", F.col("value").cast("string").alias("Score"), "ts", "event_id")
    column = {w: C.find_column(raw.columns, w) for w in ("name", "score")}
    own = raw.select(F.lower(F.col(column["name"])).alias("name"), "user_id", F.col(column["score"]).try_cast("double").alias("score"), "ts", "event_id").where("score is not null")
    seen = own.groupBy("name", "user_id").agg(F.count("*").alias("seen"), F.max_by("score", F.struct("ts", "event_id")).alias("score"))
    return seen.select("name", "user_id", "score", "seen")


@queries.add("keep_last", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def keep_last(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return C.last_by_key(own, F.col("o_custkey"), ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@queries.add("headerless_names", "SELECT s_suppkey AS model, s_name AS label, s_acctbal AS score FROM supplier")
def headerless_names(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a header get their names; a star before a label goes."""
    raw = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("*"), "s_name"), "s_acctbal").toDF("_c0", "_c1", "_c2")
    return raw.toDF("model", "label", "score").withColumn("label", F.regexp_replace("label", r"^\*+", ""))


@queries.add("literal_replacements", "SELECT p_partkey, replace(replace(p_name, 'part', 'PART'), ' ', '-') AS name FROM part")
def literal_replacements(spark: SparkSession, d: str) -> DataFrame:
    """A list of literal replacements in its order, and stars at the end of a name gone."""
    name = F.concat("p_name", F.lit("**"))
    for a, b in (("part", "PART"), (" ", "-")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(name, r"\*+$", "").alias("name"))


@queries.add("feature_subsets", "SELECT unnest(['no_price', 'only_l', 'with_tax']) AS subset, unnest([5, 7, 1])::BIGINT AS n")
def feature_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Sets of features by rules on their names."""
    names = C.numeric_columns(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"))
    sets = {"only_l": C.split_by_prefix(names, ["l_"])[0], "with_tax": [c for c in names if "tax" in c], "no_price": [c for c in names if "price" not in c and "key" not in c] + ["l_orderkey"]}
    return spark.createDataFrame([(k, len(v)) for k, v in sets.items()], "subset string, n long")
