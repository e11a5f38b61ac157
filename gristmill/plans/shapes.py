"""Queries on the shape of texts, on replies and on structured answers; inputs have missing and broken parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import columns as C
from gristmill.registering import Queries
from gristmill.session import table

queries = Queries()


def n_sql(pattern: str) -> str:
    return "len(regexp_extract_all(text, '" + pattern.replace("'", "''") + "'))"


def o_sql(part: str) -> str:
    return f"((length(text) - length(replace(text, '{part}', ''))) // {len(part)})"


W = r"regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')"
HEADERS, LISTS = n_sql(r"(?m)^\s*#{1,6}\s+"), n_sql(r"(?m)^\s*[-*+]\s+") + " + " + n_sql(r"(?m)^\s*\d+[.)]\s+")
BOLD = n_sql(r"\*\*\S(?:.*?\S)??\*\*")


def per_sql(x: str, unit: int) -> str:
    return f"CASE WHEN n > 0 THEN ({x}) * {unit}.0 / n ELSE 0 END"


def in_sql(words: tuple[str, ...]) -> str:
    return "len(list_filter(w, lambda x: lower(x) IN (" + ", ".join(f"'{x}'" for x in words) + ")))"


RATES = {
    "n_words": "n", "n_sentences": "s", "words_a_sentence": "n / s",
    "mean_word": "CASE WHEN n > 0 THEN coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / n ELSE 0 END",
    "unique_share": per_sql("len(list_distinct(list_transform(w, lambda x: lower(x))))", 1),
    "lines_per_100w": per_sql("len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))", 100),
    "headers_per_1kw": per_sql(HEADERS, 1000), "bold_per_1kw": per_sql(BOLD, 1000),
    "italic_per_1kw": per_sql(f"greatest(0, {o_sql('*')} - 4 * {BOLD}) // 2", 1000), "lists_per_1kw": per_sql(LISTS, 1000),
    "hedges_per_1kw": per_sql(in_sql(T.HEDGES), 1000), "persons_per_1kw": per_sql(in_sql(tuple(w for w in T.FIRST_PERSON if "'" not in w)), 1000),
    "dashes_per_1kw": per_sql(f"{o_sql('—')} + {o_sql('--')}", 1000), "ellipses_per_1kw": per_sql(n_sql(r"\.\.\.|…"), 1000),
    "bangs_a_sentence": f"{o_sql('!')} / s", "questions_a_sentence": f"{o_sql('?')} / s",
    "capitals_per_100w": per_sql("len(list_filter(w, lambda x: length(x) > 2 AND regexp_full_match(x, '[A-Z]+')))", 100),
}


@queries.add("shape_rates", f"WITH b AS (SELECT doc_id, text, {W} AS w, len({W})::DOUBLE AS n, greatest(1, {n_sql('[.!?]+')} + 1)::DOUBLE AS s FROM documents) SELECT doc_id, " + ", ".join(f"round(({x})::DOUBLE, 6) AS {k}" for k, x in RATES.items()) + " FROM b")
def shape_rates(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", "text", *[c.alias(k) for k, c in T.rate_parts(F.col("text")).items()])
    return own.select("doc_id", *[F.round(c, 6).alias(k) for k, c in T.word_rates(F.col("text"), {k: F.col(k) for k in own.columns[2:]}).items()])


B = f"({o_sql('**')} // 2)"
FEATURES = {
    "char_count": "length(text)", "word_count": "n", "newlines": "length(text) - length(replace(text, chr(10), ''))", "sentence_count": "s", "avg_sentence_words": "n / s",
    "first_person_rate": f"{in_sql(T.SPEAKER)} / v", "second_person_rate": f"{in_sql(T.LISTENER)} / v", "hedge_rate": f"{in_sql(T.DOUBTS)} / v",
    "question_rate": f"{o_sql('?')} / s", "exclamation_rate": f"{o_sql('!')} / s",
    "em_dashes_per_100w": f"100.0 * ({o_sql('—')} + {o_sql('--')}) / v", "ellipses_per_100w": f"100.0 * ({o_sql('…')} + {o_sql('...')}) / v",
    "bullet_lines_per_1kw": "1000.0 * " + n_sql(r"(?m)^\s*[-*•]\s") + " / v", "numbered_lines_per_1kw": "1000.0 * " + n_sql(r"(?m)^\s*\d+[.)]\s") + " / v",
    "bold_markers_per_1kw": f"1000.0 * {B} / v", "italic_markers_per_1kw": f"1000.0 * (greatest(0, {o_sql('*')} - 2 * {B}) // 2) / v",
    "all_caps_words_per_1kw": "1000.0 * len(list_filter(w, lambda x: length(x) > 2 AND upper(x) = x AND lower(x) <> x)) / v",
}


@queries.add(
    "shape_features",
    r"WITH b AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM documents), e AS (SELECT *, len(w)::DOUBLE AS n, greatest(1, len(w))::DOUBLE AS v, (" + n_sql(r"[.!?]+\s") + " + 1)::DOUBLE AS s FROM b) SELECT doc_id, "
    + ", ".join(f"round(({x})::DOUBLE, 6) AS {k}" for k, x in FEATURES.items()) + " FROM e",
)
def shape_features(spark: SparkSession, d: str) -> DataFrame:
    """The seventeen shape features that a probe of judges uses."""
    return table(spark, d, "documents").select("doc_id", *[F.round(c.cast("double"), 6).alias(k) for k, c in T.shape_features(F.col("text")).items()])


def share_sql(x: str, of: str) -> str:
    return f"CASE WHEN {of} > 0 THEN ({x}) / {of} ELSE 0 END"


LINES = {
    "chars": "c", "words": "n", "lines": "m", "mean_word": share_sql("coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)", "n"),
    "unique_words": share_sql("len(list_distinct(list_transform(w, lambda x: lower(x))))", "n"), "longest_word": "coalesce(list_max(list_transform(w, lambda x: length(x))), 0)",
    "longest_line": "list_max(list_transform(l, lambda x: length(x)))", "mean_line": share_sql("c", "m"), "short_lines": share_sql("len(list_filter(l, lambda x: length(x) < 40))", "m"),
    "empty_lines": share_sql("len(list_filter(l, lambda x: trim(x) = ''))", "m"), "digits": share_sql(n_sql("[0-9]"), "c"), "capitals": share_sql(n_sql("[A-Z]"), "c"),
    "commas": share_sql(o_sql(","), "n"), "colons": share_sql(f"{o_sql(':')} + {o_sql(';')}", "n"), "brackets": share_sql(f"{o_sql('(')} + {o_sql(')')}", "n"),
}


@queries.add("line_statistics", r"WITH b AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w, string_split(text, chr(10)) AS l, length(text)::DOUBLE AS c FROM documents), e AS (SELECT *, len(w)::DOUBLE AS n, len(l)::DOUBLE AS m FROM b) SELECT doc_id, " + ", ".join(f"round(({x})::DOUBLE, 6) AS {k}" for k, x in LINES.items()) + " FROM e")
def line_statistics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *[F.round(c, 6).alias(k) for k, c in T.line_statistics(F.col("text")).items()])


@queries.add("more_counters", "SELECT doc_id, " + n_sql(r"(?m)^\s*\|.*\|\s*$") + " AS table_rows, " + n_sql(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]") + " AS emoji, " + n_sql(r"\[[^\]]+\]\([^)]+\)") + " AS links FROM documents")
def more_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in T.many_counters(F.col("text")).items()])


REPLIES = ("Correct. Well done", " incorrect, since", "PARTIALLY right", "Maybe correct", "", "42")


@queries.add("first_word_labels", "SELECT event_id, (['Correct', 'Incorrect', 'Partially', NULL, NULL, NULL])[event_id % 6 + 1] AS label FROM events")
def first_word_labels(spark: SparkSession, d: str) -> DataFrame:
    reply = F.element_at(F.array(*[F.lit(r) for r in REPLIES]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.first_word_label(reply).alias("label"))


@queries.add("percent_and_money", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN round(o_orderkey % 1000 / 10.0, 1)::DOUBLE END AS share, CASE WHEN o_orderkey % 5 <> 4 THEN o_custkey * 1000.0::DOUBLE END AS cost FROM orders")
def percent_and_money(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    share = F.when(k % 4 == 3, "none given").otherwise(F.concat(F.lit("about "), F.format_number(k % 1000 / 10, 1), F.lit("% of runs")))
    cost = F.when(k % 5 == 4, "WARN n/a").otherwise(F.concat(F.lit("WARN $"), F.format_number(F.col("o_custkey") * 1000, 0)))
    return table(spark, d, "orders").select("o_orderkey", T.percent(share).alias("share"), T.money(cost).alias("cost"))


@queries.add("story_tags", "SELECT conv_id, turn, CASE WHEN conv_id % 4 <> 3 THEN md5(trim(text, ' ')) END AS digest FROM conversations")
def story_tags(spark: SparkSession, d: str) -> DataFrame:
    """The story of a reply without its word counts; replies without the tag have none."""
    raw = F.when(F.col("conv_id") % 4 == 3, F.col("text")).otherwise(F.concat(F.lit("Sure.\n<STORY> "), "text", F.lit(" <words>120\n</words></story> bye")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.tagged(raw, "story", ("words",))).alias("digest"))


@queries.add(
    "three_sections",
    """WITH t AS (SELECT conv_id, turn, 's' || repeat(chr(97 + (conv_id % 20)::INT), 30 * (turn::INT % 90) + 1) AS a, conv_id % 5 = 0 AS broken FROM conversations)
SELECT conv_id, turn, CASE WHEN NOT broken THEN least(length(a), 2200) + CASE WHEN length(a) > 2200 THEN 12 ELSE 0 END END AS perspective, CASE WHEN broken THEN NULL ELSE least(length(a), 1600) + CASE WHEN length(a) > 1600 THEN 12 ELSE 0 END END AS draft, 4::BIGINT AS answer FROM t""",
)
def three_sections(spark: SparkSession, d: str) -> DataFrame:
    """Three headed sections of an answer, each cut to its own width; a missing heading leaves its section null."""
    a = F.concat(F.lit("s"), F.repeat(F.chr(97 + F.col("conv_id") % 20), (30 * (F.col("turn") % 90) + 1).cast("int")))
    whole = F.concat(F.lit("# Perspective\n"), a, F.lit("\n\n## Draft:\n"), a, F.lit("\n# Final\nyes.\n"))
    text = F.when(F.col("conv_id") % 5 == 0, F.lit("no headings but one\n# Final\nyes.")).otherwise(whole)
    s = T.headed(text, ("perspective", "draft", "final"))
    n = lambda c, most: F.length(T.shortened(c, most)).cast("long")
    return table(spark, d, "conversations").select("conv_id", "turn", n(s["perspective"], 2200).alias("perspective"), n(s["draft"], 1600).alias("draft"), n(s["final"], 1600).alias("answer"))


#: Prefix -> class, tried in this order.
PROVIDERS = {
    "STANDARD": "standard", "SMALL": "small", "MEDIUM": "medium", "LARGE": "large", "ECONOMY": "economy", "PROMO": "promo",
    "gpt": "a", "claude": "b", "gemini": "c", "llama": "d", "mistral": "e", "qwen": "f", "deepseek": "g", "grok": "h",
}


@queries.add("provider_of_names", "WITH p AS (SELECT p_partkey, CASE WHEN p_type ILIKE 'STANDARD%' THEN 'standard' WHEN p_type ILIKE 'SMALL%' THEN 'small' WHEN p_type ILIKE 'MEDIUM%' THEN 'medium' WHEN p_type ILIKE 'LARGE%' THEN 'large' WHEN p_type ILIKE 'ECONOMY%' THEN 'economy' WHEN p_type ILIKE 'PROMO%' THEN 'promo' ELSE 'Other' END AS c FROM part), n AS (SELECT c, count(*) AS n FROM p GROUP BY 1) SELECT p_partkey, CASE WHEN n < 4 THEN 'Other' ELSE c END AS provider FROM p JOIN n USING (c)")
def provider_of_names(spark: SparkSession, d: str) -> DataFrame:
    """Provider by the first of fourteen prefixes; providers of fewer than four models become Other."""
    c = F.lit("Other")
    for prefix, label in reversed(list(PROVIDERS.items())):
        c = F.when(F.lower("p_type").startswith(prefix.lower()), label).otherwise(c)
    own = table(spark, d, "part").select("p_partkey", c.alias("c"))
    n = own.groupBy("c").agg(F.count("*").alias("n"))
    return own.join(n, "c").select("p_partkey", F.when(F.col("n") < 4, "Other").otherwise(F.col("c")).alias("provider"))


@queries.add("alias_names", "SELECT CASE k WHEN 'part1' THEN 'first' WHEN 'part2' THEN 'second' ELSE k END AS key, arg_min(p_name, p_partkey) AS name, count(*) AS n FROM (SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS k, p_name, p_partkey FROM part) GROUP BY 1")
def alias_names(spark: SparkSession, d: str) -> DataFrame:
    """Canonical names through a map of aliases; the first spelling seen stands for a key."""
    alias = F.create_map(*[F.lit(x) for x in ("part1", "first", "part2", "second")])
    k = T.canonical(F.col("p_name"))
    return table(spark, d, "part").groupBy(F.coalesce(alias[k], k).alias("key")).agg(F.min_by("p_name", "p_partkey").alias("name"), F.count("*").alias("n"))


@queries.add("graded_replies", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 1 THEN o_custkey % 10 END AS style, CASE WHEN o_orderkey % 6 NOT IN (1, 2) THEN o_orderkey % 10 END AS logic, o_orderkey % 6 NOT IN (1, 2, 3) AS complete FROM orders")
def graded_replies(spark: SparkSession, d: str) -> DataFrame:
    """Grades out of replies of which some are empty, lack a question or have one that was not asked; of a question
    that is graded twice the last grade counts."""
    k = F.col("o_orderkey")
    style, logic = F.format_string("Style: %d\n", F.col("o_custkey") % 10), F.format_string("noise\nLogic: %d", k % 10)
    text = F.when(k % 6 == 1, "").when(k % 6 == 2, style).when(k % 6 == 3, F.concat(style, logic, F.lit("\nTaste: 3"))).when(k % 6 == 4, F.concat(F.lit("Style: 77\n"), style, logic)).otherwise(F.concat(style, logic))
    names, values = (F.regexp_extract_all(text, F.lit(r"(\w+): (\d+)"), F.lit(g)) for g in (1, 2))
    entries = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = lambda q: F.element_at(F.filter("e", lambda x: x["k"] == q), -1)["v"].cast("bigint")
    want = F.array(F.lit("Style"), F.lit("Logic"))
    asked = F.array_distinct(F.transform("e", lambda x: x["k"]))
    own = table(spark, d, "orders").select("o_orderkey", entries.alias("e"))
    whole = (F.size(F.array_except(want, asked)) == 0) & (F.size(F.array_except(asked, want)) == 0)
    return own.select("o_orderkey", F.when(F.size(F.filter("e", lambda x: x["k"] == "Style")) > 0, last("Style")).alias("style"), F.when(F.size(F.filter("e", lambda x: x["k"] == "Logic")) > 0, last("Logic")).alias("logic"), whole.alias("complete"))


@queries.add("mention_dates", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN DATE '2024-01-01' + (c_custkey % 300)::INT WHEN 1 THEN DATE '2019-05-01' END AS updated FROM customer")
def mention_dates(spark: SparkSession, d: str) -> DataFrame:
    """The latest real date of a section; texts without one, or with impossible ones only, have none."""
    k = F.col("c_custkey")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd")
    text = F.when(k % 4 == 0, F.concat(F.lit("## Updates\n2019-05-01, "), day)).when(k % 4 == 1, "## Updates\n2019-05-01; 2020-02-30").when(k % 4 == 2, "## Updates\nsoon, 2020-13-01").otherwise(F.lit(None).cast("string"))
    dates = F.transform(F.regexp_extract_all(text, F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0)), lambda x: x.try_cast("date"))
    return table(spark, d, "customer").select("c_custkey", F.array_max(dates).alias("updated"))


@queries.add("vendor_factor_names", "WITH l AS (SELECT p_brand AS factor, p_type AS vendor, sum(p_size) AS loading FROM part GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY loading DESC, vendor) AS k FROM l), v AS (SELECT factor, vendor, k FROM t WHERE k <= 3) SELECT factor, string_agg(vendor, '/' ORDER BY k) AS name FROM v GROUP BY 1")
def vendor_factor_names(spark: SparkSession, d: str) -> DataFrame:
    """A factor named after what loads most on it: the three with the greatest loadings, in order."""
    loads = table(spark, d, "part").groupBy(F.col("p_brand").alias("factor"), F.col("p_type").alias("vendor")).agg(F.sum("p_size").alias("loading"))
    k = F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("loading"), "vendor"))
    top = loads.withColumn("k", k).where("k <= 3").groupBy("factor").agg(F.sort_array(F.collect_list(F.struct("k", "vendor"))).alias("all"))
    return top.select("factor", F.array_join(F.transform("all", lambda x: x["vendor"]), "/").alias("name"))


@queries.add("labels_by_part", "SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'auto') THEN 'cars' WHEN contains(lower(c_mktsegment), 'build') THEN 'houses' ELSE 'Other' END AS kind FROM customer")
def labels_by_part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", C.first_part(F.col("c_mktsegment"), {"auto": "cars", "build": "houses"}).alias("kind"))
