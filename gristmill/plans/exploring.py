"""Queries that explore: components, clusters, neighbours, group tests, structured text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.operators import bank
from gristmill.operators import explore as E
from gristmill.operators import factors as X
from gristmill.operators import rank as R
from gristmill.registering import Queries
from gristmill.session import table

queries = Queries()
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@queries.add("unpivot_answers", "SELECT p_partkey, q, response, CASE WHEN response IS NULL THEN 'error' WHEN response = '' THEN 'empty' ELSE 'ok' END AS status FROM (SELECT p_partkey, unnest(['Q1', 'Q2', 'Q3']) AS q, unnest([p_name, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END, CASE WHEN p_size % 5 <> 0 THEN p_type END]) AS response FROM part)")
def unpivot_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers in columns as rows with a status."""
    wide = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("Q1"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("Q2"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("Q3"))
    long = wide.unpivot("p_partkey", ["Q1", "Q2", "Q3"], "q", "response")
    return long.withColumn("status", F.when(F.col("response").isNull(), "error").when(F.col("response") == "", "empty").otherwise("ok"))


@queries.add(
    "rank_sum_test",
    """WITH r AS (SELECT s_nationkey % 2 = 0 AS g, rank() OVER (ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_acctbal) - 1) / 2.0 AS k FROM supplier),
s AS (SELECT sum(k) FILTER (WHERE g) AS w, count(*) FILTER (WHERE g) AS n1, count(*) FILTER (WHERE NOT g) AS n2 FROM r)
SELECT n1, n2, w - n1 * (n1 + 1) / 2.0 AS u, round((w - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0), 6) AS z FROM s""",
)
def rank_sum_test(spark: SparkSession, d: str) -> DataFrame:
    """Mann-Whitney U of two groups with its normal approximation. Ranks come from counts of distinct values, summed
    up range by range."""
    s = table(spark, d, "supplier").select((F.col("s_nationkey") % 2 == 0).alias("g"), "s_acctbal")
    v = s.groupBy("s_acctbal").agg(F.count_if("g").alias("a"), F.count("*").alias("n"))
    w = R.below(v, "s_acctbal", "n").select("a", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("k")).agg(F.sum(F.col("a") * F.col("k")).alias("w"), F.sum("a").alias("n1"), F.sum(F.col("n") - F.col("a")).alias("n2"))
    n1, n2 = F.col("n1"), F.col("n2")
    u = F.col("w") - n1 * (n1 + 1) / 2
    return w.select("n1", "n2", u.alias("u"), F.round((u - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6).alias("z"))


@queries.add("principal_components")
def principal_components(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").withColumn("key", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")))
    return E.principal_components(own, "key", LINE, 2)[0]


@queries.add("explained_variance")
def explained_variance(spark: SparkSession, d: str) -> DataFrame:
    """Share of variance by component, running sum and whether four fifths are reached."""
    shares = E.principal_components(table(spark, d, "lineitem"), "l_orderkey", LINE, 1)[1]
    rows = [(k + 1, float(s), float(shares[: k + 1].sum())) for k, s in enumerate(shares)]
    return spark.createDataFrame(rows, "component int, share double, cumulative double").withColumn("enough", F.col("cumulative") >= 0.8)


@queries.add("cluster_vectors")
def cluster_vectors(spark: SparkSession, d: str) -> DataFrame:
    """k-means on embeddings, k from 2 to 7 by silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).persist()
    best = max(((ClusteringEvaluator().evaluate(m.transform(data)), -k, m) for k in range(2, 8) for m in [KMeans(k=k, seed=11).fit(data)]), key=lambda x: x[:2])
    model = best[2]
    data.unpersist()
    return model.transform(data).select("vec_id", F.col("prediction").alias("cluster"))


@queries.add(
    "nearest_neighbours",
    """WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT query, vec_id, sqrt(list_sum(list_transform(list_zip(e, embedding), lambda z: power(z[1]::DOUBLE - z[2]::DOUBLE, 2)))) AS d FROM q JOIN embeddings ON vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS place FROM p) SELECT query, vec_id, round(d, 6) AS distance, place FROM r WHERE place <= 5""",
)
def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return E.neighbours(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5).withColumn("distance", F.round("distance", 6))


@queries.add("hulls")
def hulls(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_brand", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return E.hulls(part, "p_brand", "p_size", "p_retailprice")


@queries.add(
    "cluster_profile",
    """WITH c AS (SELECT l_returnflag AS cluster, avg(l_quantity) AS m FROM lineitem GROUP BY 1) SELECT cluster, round(m, 6) AS mean, round((m - avg(m) OVER ()) / stddev_pop(m) OVER (), 4) AS z FROM c""",
)
def cluster_profile(spark: SparkSession, d: str) -> DataFrame:
    """Means of clusters, and how far each stands from the others (a row for each cluster)."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("cluster")).agg(F.avg("l_quantity").alias("m"))
    w = Window.partitionBy()
    return c.select("cluster", F.round("m", 6).alias("mean"), F.round((F.col("m") - F.avg("m").over(w)) / F.stddev_pop("m").over(w), 4).alias("z"))


@queries.add("capability_profile", "WITH m AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2), z AS (SELECT user_id, event_type, (v - avg(v) OVER (PARTITION BY event_type)) / stddev(v) OVER (PARTITION BY event_type) AS z FROM m), s AS (SELECT user_id, avg(z) AS s FROM z GROUP BY 1) SELECT user_id, round(100 * (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 4) AS capability FROM s")
def capability_profile(spark: SparkSession, d: str) -> DataFrame:
    """Mean z-score over categories on a scale of 0 to 100."""
    from gristmill.operators.score import scaled

    m = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    s = m.groupBy("event_type").agg(F.avg("v").alias("a"), F.stddev("v").alias("s"))
    z = m.join(F.broadcast(s), "event_type").groupBy("user_id").agg(F.avg((F.col("v") - F.col("a")) / F.col("s")).alias("capability"))
    return scaled(z, ["capability"]).select("user_id", F.round("capability", 4).alias("capability"))


@queries.add(
    "category_profiles",
    """WITH m AS (SELECT l_partkey AS key, count(*) AS q, sum(l_extendedprice) AS e, avg(l_discount) AS s FROM lineitem GROUP BY 1),
z AS (SELECT key, (q - avg(q) OVER ()) / stddev(q) OVER () + (e - avg(e) OVER ()) / stddev(e) OVER () AS worth, (s - avg(s) OVER ()) / stddev(s) OVER () AS terms FROM m)
SELECT key, round(100 * (worth - min(worth) OVER ()) / (max(worth) OVER () - min(worth) OVER ()), 4) AS worth, round(100 * (terms - min(terms) OVER ()) / (max(terms) OVER () - min(terms) OVER ()), 4) AS terms FROM z""",
)
def category_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Each category's first component on a scale of 0 to 100 (of two columns that go together it is their sum)."""
    m = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("q"), F.sum("l_extendedprice").alias("e"), F.avg("l_discount").alias("s"))
    p = E.category_profiles(m, "key", {"worth": ["q", "e"], "terms": ["s"]})
    return p.select("key", F.round("worth", 4).alias("worth"), F.round("terms", 4).alias("terms"))


@queries.add("productivity", "SELECT o_orderkey, o_totalprice / n AS per_token FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE n > 100")
def productivity(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("n"))
    return table(spark, d, "orders").join(n, "o_orderkey").where("n > 100").select("o_orderkey", (F.col("o_totalprice") / F.col("n")).alias("per_token"))


@queries.add("graded_pairs", "SELECT o_orderkey, o_custkey % 10 AS style, o_orderkey % 10 AS logic, true AS complete FROM orders")
def graded_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Grades read from text into a map, checked against the set of questions that must be there."""
    text = F.format_string("Style: %d\nnoise\nLogic: %d", F.col("o_custkey") % 10, F.col("o_orderkey") % 10)
    pairs = F.map_from_arrays(F.regexp_extract_all(text, F.lit(r"(\w+): (\d+)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(\w+): (\d+)"), F.lit(2)))
    own = table(spark, d, "orders").select("o_orderkey", pairs.alias("g"))
    want = F.array(F.lit("Style"), F.lit("Logic"))
    grade = lambda k: F.element_at("g", F.lit(k)).try_cast("bigint")
    whole = (F.size(F.array_except(want, F.map_keys("g"))) == 0) & (F.size(F.array_except(F.map_keys("g"), want)) == 0)
    return own.select("o_orderkey", grade("Style").alias("style"), grade("Logic").alias("logic"), whole.alias("complete"))


@queries.add("sections", "SELECT conv_id, turn, length(text) AS n_view, least(length(text), 160) + CASE WHEN length(text) > 160 THEN 12 ELSE 0 END AS n_shown FROM conversations")
def sections(spark: SparkSession, d: str) -> DataFrame:
    """A structured answer cut at its headings; long sections are shortened with a mark."""
    text = F.concat(F.lit("# Perspective\n"), "text", F.lit("\n# Draft\nshort"))
    view = F.regexp_extract(text, r"(?s)# Perspective\n(.*)\n# Draft\n", 1)
    shown = F.when(F.length(view) > 160, F.concat(F.substring(view, 1, 160), F.lit(" [truncated]"))).otherwise(view)
    return table(spark, d, "conversations").select("conv_id", "turn", F.length(view).cast("long").alias("n_view"), F.length(shown).cast("long").alias("n_shown"))


@queries.add("latest_mention", "SELECT c_custkey, DATE '2024-01-01' + (c_custkey % 300)::INT AS updated FROM customer")
def latest_mention(spark: SparkSession, d: str) -> DataFrame:
    """The latest date that a text mentions."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")), "yyyy-MM-dd")
    text = F.concat(F.lit("created 2019-05-01, updated "), day, F.lit("; see also 2020-02-30"))
    dates = F.transform(F.regexp_extract_all(text, F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0)), lambda x: x.try_cast("date"))
    return table(spark, d, "customer").select("c_custkey", F.array_max(dates).alias("updated"))


@queries.add("templates", "SELECT n_nationkey, 'Compare ' || n_name || ' with ' || r_name || '.' AS prompt FROM nation JOIN region ON n_regionkey = r_regionkey")
def templates(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    filled = F.replace(F.replace(F.lit("Compare {a} with {b}."), F.lit("{a}"), F.col("n_name")), F.lit("{b}"), F.col("r_name"))
    return own.select("n_nationkey", filled.alias("prompt"))


@queries.add(
    "floor_inflation",
    """WITH v AS (SELECT l_linenumber AS col, CASE WHEN l_quantity < 12 THEN l_quantity / 10 ELSE l_quantity + 10 * (l_linenumber % 2) END AS v FROM lineitem), r AS (SELECT col, min(v) AS lo, max(v) - min(v) AS width, count(*) AS n FROM v GROUP BY 1),
s AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY v) - 1 AS i, lag(v) OVER (PARTITION BY col ORDER BY v) AS before FROM v),
p AS (SELECT s.col, v - before AS step, v, pct FROM s JOIN r USING (col), range(10, 45, 5) t(pct) WHERE i = floor(pct / 100.0 * n) AND i > 0 AND i < n - 10 AND i / n >= 0.15),
b AS (SELECT col, max(step) AS step, arg_max(v, (step, -pct)) AS threshold FROM p GROUP BY 1)
SELECT r.col, threshold::DOUBLE AS threshold, (SELECT avg(v) FROM v WHERE v.col = r.col AND v.v <= threshold) AS floor FROM r JOIN b USING (col) WHERE step >= 0.05 * width AND n >= 20 AND (SELECT count(*) FROM v WHERE v.col = r.col AND v.v <= lo + 0.25 * width) >= 0.15 * n""",
)
def floor_inflation(spark: SparkSession, d: str) -> DataFrame:
    """Columns whose values crowd at their floor: the threshold at the widest step among the lower places of the sorted
    values, and the floor's mean; a row for each such column."""
    v = table(spark, d, "lineitem").select("l_linenumber", F.when(F.col("l_quantity") < 12, F.col("l_quantity") / 10).otherwise(F.col("l_quantity") + 10 * (F.col("l_linenumber") % 2)).alias("v"))
    found = []
    for col in [r[0] for r in v.select("l_linenumber").distinct().orderBy("l_linenumber").collect()]:  # columns of a wide table
        if at := bank.floor_of(v.where(F.col("l_linenumber") == col), "v"):
            found.append((col, float(at[0]), float(at[1])))
    return spark.createDataFrame(found, "col int, threshold double, floor double")


@queries.add("factor_scores")
def factor_scores(spark: SparkSession, d: str) -> DataFrame:
    """One common factor of the part's mean line values, by maximum likelihood."""
    m = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(*[F.avg(c).alias(c) for c in LINE])
    return X.factor_scores(m, "key", LINE, 1)


@queries.add("column_families")
def column_families(spark: SparkSession, d: str) -> DataFrame:
    """Columns that say alike, by Ward's joining of 1 - |r| down to three families."""
    found = X.families(table(spark, d, "lineitem"), [*LINE, "l_linenumber"], 3)
    return spark.createDataFrame(sorted(found.items()), "column string, family int")


@queries.add("incremental_clusters")
def incremental_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Held-out R2 of the price as clusters of columns come in one after the other."""
    steps = [["l_discount", "l_tax"], ["l_quantity"], ["l_linenumber"]]
    r2 = X.incremental_r2(table(spark, d, "lineitem"), steps, "l_extendedprice", F.pmod(F.col("l_orderkey"), F.lit(5)), 5)
    return spark.createDataFrame([(k + 1, "+".join(own), v) for k, (own, v) in enumerate(zip(steps, r2, strict=True))], "step int, cluster string, r2 double")


@queries.add("smoothed_curve")
def smoothed_curve(spark: SparkSession, d: str) -> DataFrame:
    """The price along the quantity as a locally weighted line over 0.4 of the rows."""
    return spark.createDataFrame(X.smoothed(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 0.4, 32), "x double, y double")
