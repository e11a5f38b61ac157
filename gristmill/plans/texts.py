"""Queries that turn texts and conversations into features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.registering import Queries
from gristmill.session import table

queries = Queries()
N = "len(regexp_extract_all({0}, '{1}'))"


def count_sql(pattern: str, column: str = "text") -> str:
    return N.format(column, pattern.replace("'", "''"))


def parts_sql(pattern: str) -> str:
    return f"(SELECT count(*) FROM (SELECT unnest(regexp_split_to_array(text, '{pattern}')) AS s) WHERE trim(s, ' ') <> '')"


@queries.add(
    "markdown_features",
    f"""SELECT doc_id, length(text) AS n_chars, {count_sql(r"(?m)^\\s*#{1,6}\\s+".replace(chr(92) * 2, chr(92)))} AS headers,
{count_sql(r"\*\*\S(?:.*?\S)??\*\*")} + {count_sql(r"__\S(?:.*?\S)??__")} AS bold, {count_sql(r"(?m)^\s*[-*+]\s+")} + {count_sql(r"(?m)^\s*\d+[.)]\s+")} AS lists FROM documents""",
)
def markdown_features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in T.markdown(F.col("text")).items()])


@queries.add(
    "text_shape",
    rf"""SELECT doc_id, {parts_sql('[.!?]+')} AS sentences, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n_words, {parts_sql(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')} AS paragraphs,
(length(text) - length(replace(text, '```', ''))) // 3 // 2 AS code_blocks, {count_sql('`[^`]+`')} AS inline_code, {count_sql(r"(?m)^\s*>")} AS quotes,
length(text) - length(replace(text, '!', '')) AS bangs, length(text) - length(replace(text, '?', '')) AS questions, length(text) - length(replace(text, chr(10), '')) AS newlines,
length(text) - length(replace(text, '—', '')) + (length(text) - length(replace(text, '--', ''))) // 2 AS dashes, {count_sql(r"[A-Z]{3,}")} AS capitals FROM documents""",
)
def text_shape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in T.shape(F.col("text")).items()])


@queries.add("person_rate", "SELECT conv_id, turn, round(len(list_filter(w, lambda x: lower(x) IN ('i', 'i''m', 'i''d', 'i''ll', 'i''ve', 'me', 'my', 'mine', 'myself', 'we', 'our'))) / nullif(len(w), 0), 6)::DOUBLE AS rate FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z'']+') AS w FROM conversations)")
def person_rate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(T.person_rate(F.col("text")), 6).alias("rate"))


@queries.add(
    "turn_delta",
    """WITH w AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations)
SELECT conv_id, arg_min(n, turn) AS first_words, arg_max(n, turn) AS last_words, arg_max(n, turn) - arg_min(n, turn) AS delta, round(avg(n), 6) AS mean_words FROM w GROUP BY 1""",
)
def turn_delta(spark: SparkSession, d: str) -> DataFrame:
    """A feature of the first and the last turn of each conversation, and how it changes."""
    n = table(spark, d, "conversations").select("conv_id", "turn", F.size(T.words(F.col("text"))).cast("long").alias("n"))
    first, last = F.min_by("n", "turn"), F.max_by("n", "turn")
    return n.groupBy("conv_id").agg(first.alias("first_words"), last.alias("last_words"), (last - first).alias("delta"), F.round(F.avg("n"), 6).alias("mean_words"))


@queries.add("conversation_text", "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, role)) AS digest, count(*) AS turns FROM conversations GROUP BY 1")
def conversation_text(spark: SparkSession, d: str) -> DataFrame:
    """All turns of a conversation in order as one text."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"), F.count("*").alias("turns"))
    return g.select("conv_id", F.md5(F.array_join(F.transform("all", lambda t: t["text"]), "\n\n")).alias("digest"), "turns")


@queries.add("strip_reasoning", "SELECT conv_id, turn, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS digest FROM conversations")
def strip_reasoning(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.concat(F.lit(" <THINK>a\nb</think>"), "text", F.lit("<reasoning>x</reasoning>\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.without_reasoning(noisy)).alias("digest"))


@queries.add("tag_sections", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS comments, length(regexp_replace(html, '(?s)<script.*?</script>', '', 'g')) AS without_scripts FROM pages")
def tag_sections(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1).alias("title"), T.matches(html, "<a ").alias("links"), T.matches(html, r"(?s)<!--.*?-->").alias("comments"), F.length(F.regexp_replace(html, r"(?s)<script.*?</script>", "")).cast("long").alias("without_scripts"))


@queries.add("canonical_names", "SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key, min(p_name) AS name, count(*) AS n FROM part GROUP BY 1")
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(T.canonical(F.col("p_name")).alias("key")).agg(F.min("p_name").alias("name"), F.count("*").alias("n"))


@queries.add("judge_labels", "SELECT o_orderkey, (['correct', 'correct', 'incorrect', 'partial', NULL, 'incorrect'])[o_orderkey % 6 + 1] AS label FROM orders")
def judge_labels(spark: SparkSession, d: str) -> DataFrame:
    raw = F.array(*[F.lit(x) for x in (" Correct", "incorrect answer given", "INCORRECT", "Partially right", "no idea", "plainly wrong")])
    return table(spark, d, "orders").select("o_orderkey", T.judged(F.element_at(raw, (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("label"))


@queries.add("provider_classes", "SELECT CASE WHEN starts_with(p_type, 'STANDARD') THEN 'standard' WHEN starts_with(p_type, 'ECONOMY') THEN 'economy' WHEN contains(p_type, 'BRASS') THEN 'brass' ELSE 'Other' END AS provider, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 4")
def provider_classes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("p_type")
    provider = F.when(t.startswith("STANDARD"), "standard").when(t.startswith("ECONOMY"), "economy").when(t.contains("BRASS"), "brass").otherwise("Other")
    return table(spark, d, "part").groupBy(provider.alias("provider")).agg(F.count("*").alias("n")).where("n >= 4")


@queries.add("composite_keys", "SELECT event_id, user_id || '__' || event_type || '_vs_' || strftime(ts, '%Y%m%d') AS key FROM events")
def composite_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.concat("user_id", F.lit("__"), "event_type", F.lit("_vs_"), F.date_format("ts", "yyyyMMdd")).alias("key"))


@queries.add("dual_scores", "SELECT o_orderkey, o_orderkey % 130 BETWEEN 1 AND 100 AND o_custkey % 130 BETWEEN 1 AND 100 AS valid FROM orders")
def dual_scores(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text 'N,N' holds two scores from 1 to 100."""
    text = F.concat((F.col("o_orderkey") % 130).cast("string"), F.lit(", "), (F.col("o_custkey") % 130).cast("string"))
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("int"))
    return table(spark, d, "orders").select("o_orderkey", ((F.size(parts) == 2) & F.forall(parts, lambda p: F.coalesce(p.between(1, 100), F.lit(False)))).alias("valid"))


@queries.add(
    "token_chunks",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM documents), s AS (SELECT doc_id, t, unnest(range(0, greatest(len(t), 1), 432)) AS a FROM w)
SELECT doc_id, count(*) AS chunks, sum(len(t[a + 1 : a + 480]))::BIGINT AS tokens FROM s WHERE a = 0 OR len(t[a + 1 : a + 480]) >= 32 GROUP BY 1""",
)
def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = T.chunks(T.words(F.col("text")), 480, 48, 32)
    tokens = F.aggregate(F.transform("c", F.size), F.lit(0), lambda a, b: a + b)
    return table(spark, d, "documents").select("doc_id", c.alias("c")).select("doc_id", F.size("c").cast("long").alias("chunks"), tokens.cast("long").alias("tokens"))


@queries.add("word_statistics", "SELECT doc_id, round(avg(length(w)), 9) AS mean_length, round(count(DISTINCT lower(w)) / count(*), 6)::DOUBLE AS unique_share FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY 1")
def word_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Mean length and share of distinct words, inside the row: no word leaves its document."""
    w = T.words(F.col("text"))
    own = table(spark, d, "documents").select("doc_id", w.alias("w")).where(F.size("w") > 0)
    letters = F.aggregate(F.transform("w", F.length), F.lit(0), lambda a, b: a + b)
    return own.select("doc_id", F.round(letters / F.size("w"), 9).alias("mean_length"), F.round(F.size(F.array_distinct(F.transform("w", F.lower))) / F.size("w"), 6).alias("unique_share"))


@queries.add("labelled_documents", "SELECT source, count(*) AS n, sum(quality)::BIGINT AS good, round(avg(toxic), 6) AS toxic_share, round(avg(n_chars), 4) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def labelled_documents(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return own.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.round(F.avg("toxic"), 6).alias("toxic_share"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))
