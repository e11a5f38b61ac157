"""Queries that clean, type, filter and profile columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import clean as C
from gristmill.operators.combine import missing_share
from gristmill.registering import Queries
from gristmill.session import table

queries = Queries()
TYPES = ["click", "purchase", "signup", "view"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def user_days(spark: SparkSession, d: str) -> DataFrame:
    """A sparse matrix: a row for each user and day, a column for each event type, mean values as cells."""
    events = table(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("entity"), "event_type", "value")
    return events.groupBy("entity").pivot("event_type", TYPES).agg(F.round(F.avg("value"), 4))


MATRIX = "m AS (SELECT cast(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS entity, " + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{t}'), 4) AS {t}" for t in TYPES) + " FROM events GROUP BY 1)"
MISSING = "(" + " + ".join(f"({t} IS NULL)::INT" for t in TYPES) + ") / 4.0"


@queries.add(
    "infer_types",
    """SELECT p_partkey, p_size::DOUBLE AS share, CASE WHEN p_partkey % 50 = 49 THEN 'bad%' ELSE p_size || '%' END AS broken,
CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size / 4.0 END::DOUBLE AS mixed, 'http://x/' || p_size AS link FROM part""",
)
def infer_types(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    raw = table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit(" "), size, F.lit("%\n")).alias("share"),
        F.when(F.col("p_partkey") % 50 == 49, "bad%").otherwise(F.concat(size, F.lit("%"))).alias("broken"),
        F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise((F.col("p_size") / 4).cast("string")).alias("mixed"),
        F.concat(F.lit("http://x/"), size).alias("link"),
    )
    return C.typed(raw, ["share", "broken", "mixed", "link"], "p_partkey")


@queries.add("row_coverage", f"WITH {MATRIX} SELECT *, round({MISSING}, 4)::DOUBLE AS missing FROM m WHERE {MISSING} < 0.508")
def row_coverage(spark: SparkSession, d: str) -> DataFrame:
    m = user_days(spark, d)
    return m.withColumn("missing", F.round(missing_share(TYPES), 4)).where(missing_share(TYPES) < 0.508)


@queries.add(
    "dense_column_completeness",
    f"WITH {MATRIX}, dense AS (SELECT * FROM m WHERE {MISSING} < 0.508) " + " UNION ALL ".join(f"SELECT '{t}' AS column_name, count(*) AS n_rows, round(avg(({t} IS NOT NULL)::INT), 6) AS complete FROM dense HAVING avg(({t} IS NOT NULL)::INT) >= 0.28" for t in TYPES),
)
def dense_column_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Share of filled cells by column, measured on well-covered rows only; thin columns drop out."""
    dense = user_days(spark, d).where(missing_share(TYPES) < 0.508)
    cells = C.long_form(dense, "entity", TYPES)
    complete = cells.groupBy(F.col("column").alias("column_name")).agg(F.count("*").alias("n_rows"), F.avg(F.col("value").isNotNull().cast("int")).alias("complete"))
    return complete.where("complete >= 0.28").withColumn("complete", F.round("complete", 6))


@queries.add("drop_all_null_rows", f"WITH {MATRIX} SELECT entity, click, signup FROM m WHERE click IS NOT NULL OR signup IS NOT NULL")
def drop_all_null_rows(spark: SparkSession, d: str) -> DataFrame:
    return user_days(spark, d).select("entity", "click", "signup").dropna("all", subset=["click", "signup"])


@queries.add("missing_flags", f"WITH {MATRIX} SELECT entity, " + ", ".join(f"({t} IS NULL)::INT AS {t}_was_missing" for t in TYPES) + " FROM m")
def missing_flags(spark: SparkSession, d: str) -> DataFrame:
    """Missingness as columns of its own, for columns with at least 5 nulls and 5 values."""
    m = user_days(spark, d)
    n = m.agg(F.count("*").alias("n"), *[F.count(t).alias(t) for t in TYPES]).first()
    kept = [t for t in TYPES if 5 <= n["n"] - n[t] <= n["n"] - 5]
    return m.select("entity", *[F.col(t).isNull().cast("int").alias(f"{t}_was_missing") for t in kept])


@queries.add(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct, min({c})::DOUBLE AS least, max({c})::DOUBLE AS greatest,
(SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})) AS n_commonest, bool_and(abs({c} - round({c})) <= 1e-6) AS whole_numbers FROM lineitem"""
        for c in NUMBERS
    ),
)
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return C.profile(C.long_form(lines, "l_orderkey", NUMBERS))


@queries.add(
    "low_variance_columns",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, round(max(n) / sum(n), 6)::DOUBLE AS dominance, max(n) / sum(n) >= 0.7 OR sum(n) - max(n) < 2 AS is_low FROM (SELECT count(*) AS n FROM {t} GROUP BY {c})"""
        for c, t in (("l_linestatus", "lineitem"), ("l_returnflag", "lineitem"), ("l_linenumber", "lineitem"))
    ),
)
def low_variance_columns(spark: SparkSession, d: str) -> DataFrame:
    columns = ["l_linestatus", "l_returnflag", "l_linenumber"]
    cells = table(spark, d, "lineitem").select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    n = cells.groupBy("c", "v").count().groupBy(F.col("c").alias("column_name")).agg(F.max("count").alias("top"), F.sum("count").alias("n"))
    share = F.col("top") / F.col("n")
    return n.select("column_name", F.round(share, 6).alias("dominance"), ((share >= 0.7) | (F.col("n") - F.col("top") < 2)).alias("is_low"))


@queries.add(
    "numeric_categoricals",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name FROM lineitem HAVING count(DISTINCT {c}) <= 10 AND bool_and(abs({c} - round({c})) <= 1e-6)" for c in NUMBERS),
)
def numeric_categoricals(spark: SparkSession, d: str) -> DataFrame:
    p = C.profile(C.long_form(table(spark, d, "lineitem"), "l_orderkey", NUMBERS))
    return p.where("n_distinct <= 10 and whole_numbers").select(F.col("column").alias("column_name"))


@queries.add(
    "safety_fill",
    f"WITH {MATRIX} SELECT entity, " + ", ".join(f"round(coalesce({t}, (SELECT median({t}) FROM m), 0), 4) AS {t}" for t in TYPES) + " FROM m",
)
def safety_fill(spark: SparkSession, d: str) -> DataFrame:
    m = user_days(spark, d)
    odd = m.withColumn("click", F.when(F.col("click").isNull(), float("inf")).otherwise(F.col("click")))
    return C.filled(odd, TYPES).select("entity", *[F.round(t, 4).alias(t) for t in TYPES])


@queries.add("judge_names", "SELECT DISTINCT source || ' ' || lang AS judge FROM documents")
def judge_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("  "), F.col("source"), F.lit(" \t\n "), F.col("lang"), F.lit(" "))
    return table(spark, d, "documents").select(C.one_space(raw).alias("judge")).distinct()


@queries.add(
    "cost_projection",
    """SELECT l_orderkey, l_linenumber, least(a, b, c) AS cheapest, greatest(a, b, c) AS dearest, a + b + c - least(a, b, c) - greatest(a, b, c) AS middle FROM (
SELECT l_orderkey, l_linenumber, round(l_quantity * 3) AS a, round(l_extendedprice / 100) AS b, round(l_quantity * 1000 * l_discount) AS c FROM lineitem) WHERE least(a, b, c) > 0""",
)
def cost_projection(spark: SparkSession, d: str) -> DataFrame:
    """Three cost scenarios of a row with the least, the greatest and the median."""
    three = [F.round(F.col("l_quantity") * 3), F.round(F.col("l_extendedprice") / 100), F.round(F.col("l_quantity") * 1000 * F.col("l_discount"))]
    s = F.array_sort(F.array(*three))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s[0].alias("cheapest"), s[2].alias("dearest"), s[1].alias("middle")).where("cheapest > 0")


@queries.add("residuals", "SELECT event_id, value - avg(value) OVER (PARTITION BY event_type) > 0 AS above, round(value - avg(value) OVER (PARTITION BY event_type), 3) AS residual FROM events")
def residuals(spark: SparkSession, d: str) -> DataFrame:
    """Actual minus predicted, the prediction being the mean of the event's type (few types, joined by broadcast)."""
    events = table(spark, d, "events")
    means = events.groupBy("event_type").agg(F.avg("value").alias("predicted"))
    r = F.col("value") - F.col("predicted")
    return events.join(F.broadcast(means), "event_type").select("event_id", (r > 0).alias("above"), F.round(r, 3).alias("residual"))


@queries.add("row_validation", "SELECT count(*) AS n, sum((NOT o_totalprice BETWEEN 1000 AND 400000)::INT)::BIGINT AS bad_price, sum((o_orderstatus NOT IN ('F', 'O'))::INT)::BIGINT AS bad_status, sum((o_orderkey < 1)::INT)::BIGINT AS bad_key FROM orders")
def row_validation(spark: SparkSession, d: str) -> DataFrame:
    bad = lambda c, n: F.sum((~c).cast("int")).alias(n)
    return table(spark, d, "orders").agg(F.count("*").alias("n"), bad(F.col("o_totalprice").between(1000, 400000), "bad_price"), bad(F.col("o_orderstatus").isin("F", "O"), "bad_status"), bad(F.col("o_orderkey") >= 1, "bad_key"))


@queries.add(
    "table_verdicts",
    """SELECT o_orderpriority AS source, count(*) AS n, (sum((o_totalprice IS NULL OR NOT o_totalprice BETWEEN 600 AND 400000)::INT) + sum((o_custkey < 1)::INT))::BIGINT AS issues,
count(*) >= 20 AND sum((o_totalprice IS NULL OR NOT o_totalprice BETWEEN 600 AND 400000)::INT) + sum((o_custkey < 1)::INT) <= 10 AS valid FROM orders GROUP BY 1""",
)
def table_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Whether a source's rows can be taken: enough of them, and at most ten issues of range over all its fields."""
    return C.verdicts(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "source"), "source", {"o_totalprice": (600, 400000), "o_custkey": (1, None)}, 20, 10)


@queries.add("formatted_rows", "SELECT o_orderkey, floor(o_totalprice)::BIGINT % 100 || '___' || (floor(o_totalprice)::BIGINT % 100 + 5) AS rank_spread, format('{:,}', o_orderkey * 1000) AS votes FROM orders")
def formatted_rows(spark: SparkSession, d: str) -> DataFrame:
    rank = F.floor("o_totalprice") % 100
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws("___", rank.cast("string"), (rank + 5).cast("string")).alias("rank_spread"), F.format_number(F.col("o_orderkey") * 1000, 0).alias("votes"))


@queries.add("parse_numbers", "SELECT p_partkey, p_size::DOUBLE AS share, p_partkey * 1000.0::DOUBLE AS votes, p_size / 2.0::DOUBLE AS margin, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS price FROM part")
def parse_numbers(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    text = table(spark, d, "part").select(
        "p_partkey", F.concat(size.cast("string"), F.lit("%")).alias("share"), F.format_number(F.col("p_partkey") * 1000, 0).alias("votes"),
        F.concat(F.lit("±"), (size / 2).cast("string")).alias("margin"),
        F.when(F.col("p_partkey") % 3 == 0, "-").otherwise(F.concat(F.lit("$"), F.col("p_retailprice").cast("string"))).alias("price"),
    )
    return text.select("p_partkey", *[C.number(F.col(c)).alias(c) for c in ("share", "votes", "margin", "price")])


@queries.add("truth_flags", "SELECT o_orderkey, o_orderkey % 5 IN (0, 1, 2) AS flag FROM orders")
def truth_flags(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in (" True ", "YES", "1", "no", "False")])
    return table(spark, d, "orders").select("o_orderkey", C.truth(F.element_at(words, (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("flag"))


@queries.add("json_from_noise", "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def json_from_noise(spark: SparkSession, d: str) -> DataFrame:
    """A JSON object out of fenced or surrounded text; null where it does not parse."""
    noisy = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 3, F.concat(F.lit("no {object: "), "props")).otherwise(F.concat(F.lit("Sure: "), "props", F.lit(" done")))
    parsed = F.try_variant_get(F.try_parse_json(C.json_part(noisy)), "$.k", "bigint")
    return table(spark, d, "events").select("event_id", parsed.alias("k"))


@queries.add("date_parts", "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-08-02')::INT AS age, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    text = F.date_format("o_orderdate", "M/d/yy")
    """Dates from text with two-digit years, of which 69 to 99 are of the last century."""
    read = F.expr("try_to_date(__day, 'M/d/yy')")
    day = F.when(F.year(read) >= 2069, F.add_months(read, -1200)).otherwise(read)
    own = table(spark, d, "orders").select("o_orderkey", text.alias("__day"))
    return own.select("o_orderkey", F.datediff(F.lit("1998-08-02").cast("date"), day).alias("age"), F.date_format(day, "yyyy-MM-dd").alias("day"))
