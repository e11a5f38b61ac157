"""URL filter: rules by host and path, and a Bloom filter cascade over the corpus's complete key universe.

Level 1 holds the listed keys. What passes it without being listed goes into level 2, the listed keys that pass
level 2 go into level 3, and so on until a level lets nothing wrong through. A key of the universe is listed if the
first level that rejects it has an even number, which is exact. Filters are arrays of 64-bit words; rows meet them
as scalar values, so that no row is shuffled or joined. Keys are dealt by hash over as many shards as it takes for a
shard's cascade to have SHARD_WORDS words or so; rows meet one shard's cascade after the other, so that what goes to
the tasks at once is bounded at any size. All of it is DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import UPPER, ascii_lower, new_path, only, stored

#: (verdict, host, path): a rule holds for its host and all subdomains, for paths that begin with its own.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: False positives that level 2 and later let through, as a power of 2.
LATER_BITS = 5
#: Words (8 bytes) of one shard's cascade, of all its levels together, that go to the tasks at once.
SHARD_WORDS = 1 << 20
#: A host is listed if at least this share of its pages carries a tracking parameter in the url.
TRACKED_SHARE = 0.5
TRACKING = "utm_source="


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    own = only(pages, "page_id", "url")
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    own = own.withColumn("rest", F.coalesce(rest, F.lit("")))
    raw = F.regexp_extract("rest", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(F.col("rest"), F.length(raw) + 1, F.length("rest")), r"^[^?#]*", 0)
    return own.select("page_id", "url", ascii_lower(raw).alias("host"), path.alias("path"))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that holds, as text, and its verdict; both null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        holds = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(holds, h + p).otherwise(text), F.when(holds, v).otherwise(verdict)
    return text, verdict


def hash_bits(n: int, m: int) -> int:
    """Hashes of the first level for n listed keys among m others."""
    return max(1, math.ceil(math.log2(max(2.0, m * math.sqrt(2) / max(1, n)))))


class Cascade:
    """Exact membership of a universe's keys in a listed subset."""

    def __init__(self, universe: DataFrame, listed: DataFrame):
        """``universe`` and ``listed``: one column ``key``, without repeats or nulls, listed within universe."""
        self.spark = universe.sparkSession
        marked = universe.select("key").join(listed.select("key", F.lit(True).alias("in")), "key", "left")
        keys = stored(marked.select("key", F.coalesce("in", F.lit(False)).alias("in")), "universe")
        n, all_ = keys.agg(F.count_if("in"), F.count("*")).first()
        # The later levels together have about as many words as the first one, at most.
        words = n * (hash_bits(n, all_ - n) + LATER_BITS) / math.log(2) / 64
        self.n_shards = max(1, math.ceil(words / SHARD_WORDS))
        if self.n_shards > 1:
            path = new_path(self.spark, "universe-shards")
            keys.withColumn("shard", self._shard(F.col("key"))).write.partitionBy("shard").parquet(path)
            keys = self.spark.read.parquet(path)
        #: per shard (bits, hashes, filter) of each level; filter has one row with the column ``words``
        self.levels: list[list[tuple[int, int, DataFrame]]] = []
        for shard in range(self.n_shards if n else 0):
            own = keys.where(F.col("shard") == shard).select("key", "in") if self.n_shards > 1 else keys
            self.levels.append(self._built(own.where("in").select("key"), own.where("not in").select("key")))

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(self.n_shards)).cast("int")

    def _built(self, inside: DataFrame, others: DataFrame) -> list[tuple[int, int, DataFrame]]:
        levels: list[tuple[int, int, DataFrame]] = []
        n = inside.count()
        while n:
            hashes = LATER_BITS if levels else hash_bits(n, others.count())
            words = max(1, math.ceil(n * hashes / math.log(2) / 64))
            level = len(levels) + 1
            levels.append((words * 64, hashes, self._filter(inside, level, words, hashes)))
            passed = stored(others.where(self._passes(F.col("key"), level, levels[-1])), "passed")
            inside, others, n = passed, inside, passed.count()
        return levels

    @staticmethod
    def _position(key: Column, level: int, j: int, bits: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits))

    def _filter(self, keys: DataFrame, level: int, words: int, hashes: int) -> DataFrame:
        at = keys.select(F.explode(F.array(*[self._position(F.col("key"), level, j, words * 64) for j in range(hashes)])).alias("at"))
        bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
        set_ = at.select(F.shiftright("at", 6).alias("id"), bit.alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
        dense = self.spark.range(words).join(set_, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
        row = dense.agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("all"))  # a shard's words
        return stored(row.select(F.transform("all", lambda x: x["bits"]).alias("words")), "filter")

    def _passes(self, key: Column, level: int, filter_: tuple[int, int, DataFrame]) -> Column:
        bits, hashes, row = filter_
        words, tests = row.select("words").scalar(), F.lit(True)
        for j in range(hashes):
            at = self._position(key, level, j, bits)
            tests = tests & (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1)
        return tests

    def contains(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """``rows`` with the boolean column ``name``; every key must be of the universe. Null keys are not in it.

        With several shards the rows are dealt out by shard, and each part is judged by its own filters, one shard's at
        a time: every row is written twice, however many shards there are.
        """
        if self.n_shards == 1 or not self.levels:
            return rows.withColumn(name, self._member(F.col(key), self.levels[0]) if self.levels else F.lit(False))
        at, path = "__shard", new_path(self.spark, "shard-rows")
        dealt = rows.withColumn(at, self._shard(F.col(key)))
        dealt.write.partitionBy(at).parquet(path)
        dealt, out = self.spark.read.schema(dealt.schema).parquet(path), None
        for shard, levels in enumerate(self.levels):
            own = dealt.where(F.col(at) == shard).drop(at)
            judged = stored(own.withColumn(name, self._member(F.col(key), levels)), "shard-judged")
            out = judged if out is None else out.unionByName(judged)
        return out

    def _member(self, key: Column, levels: list[tuple[int, int, DataFrame]]) -> Column:
        member = F.lit(False)
        for level in range(len(levels), 0, -1):
            member = self._passes(key, level, levels[level - 1]) & ~member
        return F.coalesce(member, F.lit(False))


def tracked_hosts(urls: DataFrame) -> DataFrame:
    """key: hosts (not the empty one) with at least TRACKED_SHARE of their pages under tracking urls."""
    tracked = F.coalesce(F.col("url").contains(TRACKING), F.lit(False)).cast("int")
    shares = urls.where("host != ''").groupBy(F.col("host").alias("key")).agg(F.avg(tracked).alias("share"))
    return shares.where(F.col("share") >= TRACKED_SHARE).select("key")


def url_report(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    Verdict: the rule's, else block if the cascade finds the host listed, else allow. Null urls and those without
    :// have empty host and path and are allowed. Repeated rows stay rows of their own. Of rules that hold the longest
    wins; two of one length cannot both hold unless they are equal. Very long urls are read whole, an empty table gives
    an empty result, and other columns (also ones called host or listed) are not looked at.
    """
    urls = parsed(pages)
    cascade = Cascade(urls.select(F.col("host").alias("key")).distinct(), tracked_hosts(urls))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    judged = cascade.contains(urls, "host", "listed")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


ORACLE_SQL = f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), urls AS (
  SELECT page_id, url, translate(raw, '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM parts
), listed AS (
  SELECT host FROM urls WHERE host <> '' GROUP BY host
  HAVING avg(CASE WHEN contains(url, '{TRACKING}') THEN 1.0 ELSE 0.0 END) >= {TRACKED_SHARE}
), ruled AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
         WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM urls
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
