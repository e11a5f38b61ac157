"""Reversible line dedup: exact reference counts per line key, sharded cuckoo filters over the shared keys.

State (Parquet tables in one folder; every change adds a generation, none rewrites another's files):

* ``postings``  doc_id, h, g, delta: +1 when a document that holds the key comes in, -1 when it is deleted;
* ``refs``      h, g, n_docs, keeper, was: for each key of the change its exact reference count, the smallest doc_id
                left and the count before; the latest generation of a key holds;
* ``filters``   shard, buckets, slots: cuckoo filters of the *shared* keys (n_docs of 2 or more) of changed shards;
* ``manifest``  one row for each finished generation, written last: a change that was broken off leaves no trace.

A change reads the reference counts and writes only what it touches. Keys whose count rises to 2 are inserted in
their shard's filter, keys that fall below 2 are deleted from it, which a Bloom filter could not do. After
``MERGE_AFTER`` generations, or when shards have outgrown their size, counts are merged into one generation and the
filters are built anew. ``apply`` deals lines out as the filters are, screens each shard's lines by its filter, and
only what passes goes on to the exact table.

Keys are 128 bits drawn from the SHA-256 of the line: ``h`` for the filters and ``g`` for the shards.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import BLANKS, ascii_lower, new_path, only, stored

MIN_CODE_POINTS = 10
#: Shared keys that one shard is meant to hold, and lines of a shard that one task screens at once.
SHARD_KEYS, PART_LINES = 200_000, 400_000
#: Generations of reference counts that are read side by side before they are merged.
MERGE_AFTER = 8
SLOTS = 4
POSTINGS = "doc_id long, h long, g long, delta int"
REFS = "h long, g long, n_docs long, keeper long, was long"
FILTERS = "shard int, buckets long, slots binary"
MANIFEST = "generation int, name string, base int, shards int, n_shared long"


class CuckooFilter:
    """Partial-key cuckoo filter over 64-bit hashes: 16-bit fingerprints, four to a bucket.

    Never misses a key it holds. ``delete`` takes out one copy of a key that was inserted before.
    """

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = int(buckets)
        self.slots = np.zeros((self.buckets, SLOTS), np.uint16) if slots is None else slots.reshape(self.buckets, SLOTS)

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, n) / SLOTS / 0.8)))))

    @classmethod
    def load(cls, buckets: int, data: bytes, change: bool = False) -> CuckooFilter:
        slots = np.frombuffer(data, np.uint16)
        return cls(buckets, slots.copy() if change else slots)

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.asarray(hashes).astype(np.int64).view(np.uint64)
        mark = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ ((np.asarray(mark).astype(np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(hashes)
        return (self.slots[a] == mark[:, None]).any(1) | (self.slots[b] == mark[:, None]).any(1)

    def insert(self, hashes: np.ndarray) -> bool:
        """False if the filter is too full; the caller then builds a larger one from the exact table."""
        mark, a, b = self._places(hashes)
        left = np.arange(len(mark))
        for at in (a, b):  # all at once where a bucket has room; then the rest kick others out
            self.slots = np.ascontiguousarray(np.sort(self.slots, axis=1)[:, ::-1])
            used = np.count_nonzero(self.slots, axis=1)
            left = left[np.argsort(at[left], kind="stable")]
            bucket = at[left]
            slot = used[bucket] + np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            fits = slot < SLOTS
            self.slots[bucket[fits], slot[fits]] = mark[left[fits]]
            left = left[~fits]
        return all(self._kick(mark[k], int(b[k])) for k in left)

    def _kick(self, mark: np.uint16, at: int) -> bool:
        for turn in range(500):
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = mark
                return True
            k = turn % SLOTS
            mark, self.slots[at, k] = self.slots[at, k], mark
            at = int(self._other(at, mark))
        return False

    def delete(self, hashes: np.ndarray) -> None:
        for mark, a, b in zip(*self._places(hashes), strict=True):
            for at in (a, b):
                found = np.flatnonzero(self.slots[at] == mark)
                if len(found):
                    self.slots[at, found[0]] = 0
                    break


def filled(hashes: np.ndarray) -> CuckooFilter:
    """A filter of these keys, as large as it must be."""
    n = len(hashes)
    while not (f := CuckooFilter.sized(n)).insert(hashes):
        n = 2 * n + 8
    return f


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def key_of(line: Column) -> Column:
    """h and g: 128 bits drawn from the SHA-256 of the key; null for keys too short to count."""
    key = line_key(line)
    digest = F.sha2(key, 256)
    return F.when(F.length(key) >= MIN_CODE_POINTS, F.struct(F.xxhash64(digest).alias("h"), F.xxhash64(F.lit(1), digest).alias("g")))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_mark(text: Column) -> Column:
    """Tells rows of one doc_id apart; rows with the same text lose the same lines."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, pos, h, g: the lines that have a key. Rows without doc_id have none."""
    return (
        only(docs, "doc_id", "text")
        .where(F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long"), row_mark(F.col("text")).alias("row"), F.posexplode(F.transform(lines_of(F.col("text")), key_of)).alias("pos", "key"))
        .where(F.col("key").isNotNull())
        .select("doc_id", "row", "pos", "key.h", "key.g")
    )


class LineIndex:
    """The reversible state in a shared folder; see the module's text.

    A path that holds an index is opened and goes on where it ended, in any session. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int | None = None):
        self.spark, self.path, self.wanted = spark, path or new_path(spark, "lines"), shards
        self.done = self._manifest()

    def _manifest(self) -> list:
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/*").collect()  # a row for each change
        except AnalysisException:
            return []
        return sorted(rows, key=lambda r: r["generation"])

    # --- tables -----------------------------------------------------------------------------------------------
    @property
    def shards(self) -> int:
        return self.done[-1]["shards"] if self.done else self.wanted or 1

    def _read(self, what: str, schema: str, name: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}/{name}")

    def _live(self) -> list:
        """The generations from the last merged one on."""
        return [r for r in self.done if r["generation"] >= self.done[-1]["base"]]

    def postings(self) -> DataFrame:
        """Live (doc_id, h, g): deltas sum to 1 for a document that is in, to 0 for a deleted one."""
        if not self.done:
            return self.spark.createDataFrame([], POSTINGS).drop("delta")
        log = self.spark.read.schema(POSTINGS).parquet(*[f"{self.path}/postings/{r['name']}" for r in self.done])
        if len(self.done) == 1:
            return log.drop("delta")
        return log.groupBy("doc_id", "h", "g").agg(F.sum("delta").alias("n")).where("n > 0").drop("n")

    def refs(self) -> DataFrame:
        """h, g, n_docs, keeper of every key that was ever held; n_docs is 0 for those that are held no more."""
        if not self.done:
            return self.spark.createDataFrame([], REFS).drop("was")
        parts = [self._read("refs", REFS, r["name"]).withColumn("generation", F.lit(r["generation"])) for r in self._live()]
        if len(parts) == 1:
            return parts[0].select("h", "g", "n_docs", "keeper")
        all_ = parts[0]
        for p in parts[1:]:
            all_ = all_.unionByName(p)
        latest = all_.groupBy("h", "g").agg(F.max(F.struct("generation", "n_docs", "keeper")).alias("last"))
        return latest.select("h", "g", "last.n_docs", "last.keeper")

    def filters(self) -> DataFrame:
        """The latest filter of each shard."""
        all_ = self.spark.createDataFrame([], FILTERS).withColumn("generation", F.lit(0))
        for r in self._live() if self.done else ():
            all_ = all_.unionByName(self._read("filters", FILTERS, r["name"]).withColumn("generation", F.lit(r["generation"])))
        latest = all_.groupBy("shard").agg(F.max_by(F.struct("buckets", "slots"), "generation").alias("last"))
        return latest.select("shard", "last.buckets", "last.slots")

    def _shard(self, shards: int | None = None) -> Column:
        return F.pmod(F.col("g"), F.lit(shards or self.shards)).cast("int").alias("shard")

    # --- changes ----------------------------------------------------------------------------------------------
    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents. Those that are in already (same doc_id and key) count once."""
        return self._insert(keyed_lines(docs))

    def _insert(self, lines: DataFrame) -> LineIndex:
        keys = lines.select("doc_id", "h", "g").distinct()
        if self.done:
            keys = keys.join(self.postings(), ["doc_id", "h", "g"], "left_anti")
        return self._change(keys, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Takes documents out again, by doc_id; their text is not needed."""
        gone = only(docs, "doc_id").select(F.col("doc_id").cast("long")).distinct()
        return self._change(self.postings().join(gone, "doc_id", "left_semi"), -1)

    def update(self, docs: DataFrame) -> LineIndex:
        """The documents with these texts in place of those they had."""
        return self.delete(docs).insert(docs)

    def _change(self, keys: DataFrame, delta: int) -> LineIndex:
        at = self.done[-1]["generation"] + 1 if self.done else 1
        name = f"{at:06d}-{uuid.uuid4().hex[:8]}"
        keys.select("doc_id", "h", "g", F.lit(delta).alias("delta")).write.parquet(f"{self.path}/postings/{name}")
        batch = self._read("postings", POSTINGS, name)
        self._counted(batch, delta).write.parquet(f"{self.path}/refs/{name}")
        refs = self._read("refs", REFS, name)
        more = refs.agg(F.sum((F.col("n_docs") > 1).cast("long") - (F.col("was") > 1).cast("long"))).first()[0] or 0
        shared = (self.done[-1]["n_shared"] if self.done else 0) + more
        base, shards = (self.done[-1]["base"], self.shards) if self.done else (at, self.wanted or 0)
        grown = not self.wanted and shared > 2 * SHARD_KEYS * max(1, shards)
        if not self.done or grown or at - base >= MERGE_AFTER:
            shards = self.wanted or max(1, -(-shared // SHARD_KEYS))
            if self.done:
                self.done.append(self._row(at, name, base, shards, shared))
                merged = self.refs().where("n_docs > 0").withColumn("was", F.lit(0).cast("long"))
                self.done.pop()
                name_all = f"{name}-all"
                merged.write.parquet(f"{self.path}/refs/{name_all}")
                batch.write.parquet(f"{self.path}/postings/{name_all}")
                name, base = name_all, at
                refs = self._read("refs", REFS, name)
            self._built(refs.where("n_docs > 1"), shards).write.parquet(f"{self.path}/filters/{name}")
        else:
            self._filters_after(refs, name)
        row = self._row(at, name, base, shards, shared)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/{name}")
        self.done.append(row)
        return self

    @staticmethod
    def _row(at: int, name: str, base: int, shards: int, shared: int):
        return Row(generation=at, name=name, base=base, shards=shards, n_shared=shared)

    def _counted(self, batch: DataFrame, delta: int) -> DataFrame:
        """REFS of the batch's keys. Only a key whose keeper left is looked up in the postings."""
        change = batch.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
        if not self.done:
            return change.select("h", "g", F.col("n").alias("n_docs"), F.col("least").alias("keeper"), F.lit(0).cast("long").alias("was"))
        old = self.refs().select("h", "g", F.col("n_docs").alias("was"), "keeper")
        both = change.join(old, ["h", "g"], "left").withColumn("was", F.coalesce("was", F.lit(0)))
        if delta > 0:
            return both.select("h", "g", (F.col("was") + F.col("n")).alias("n_docs"), F.least("keeper", "least").alias("keeper"), "was")
        both = stored(both.withColumn("n_docs", F.col("was") - F.col("n")), "counted")
        orphans = both.where("least = keeper and n_docs > 0").select("h", "g")
        left = self.postings().join(orphans, ["h", "g"], "left_semi").join(batch.select("doc_id", "h", "g"), ["doc_id", "h", "g"], "left_anti")
        heirs = left.groupBy("h", "g").agg(F.min("doc_id").alias("heir"))
        keeper = F.when(F.col("n_docs") > 0, F.coalesce("heir", "keeper"))
        return both.join(heirs, ["h", "g"], "left").select("h", "g", "n_docs", keeper.alias("keeper"), "was")

    def _built(self, shared: DataFrame, shards: int) -> DataFrame:
        return shared.select(self._shard(shards), "h").groupBy("shard").applyInPandas(built, FILTERS)

    def _filters_after(self, refs: DataFrame, name: str) -> None:
        move = (F.col("n_docs") > 1).cast("int") - (F.col("was") > 1).cast("int")
        moves = refs.select(self._shard(), "h", move.alias("move")).where("move != 0")
        touched = self.filters().join(moves.select("shard").distinct(), "shard", "left_semi")
        changed_ = stored(moves.groupBy("shard").cogroup(touched.groupBy("shard")).applyInPandas(changed, FILTERS), "filters")
        # A filter that ran full comes back empty and is built anew from the exact counts.
        full = changed_.where("buckets = 0").select("shard")
        latest = self.refs().join(refs.select("h", "g"), ["h", "g"], "left_anti").unionByName(refs.drop("was")).where("n_docs > 1")
        anew = latest.select(self._shard(), "h").join(full, "shard", "left_semi").groupBy("shard").applyInPandas(built, FILTERS)
        changed_.where("buckets > 0").unionByName(anew).write.parquet(f"{self.path}/filters/{name}")

    # --- use --------------------------------------------------------------------------------------------------
    def screened(self, lines: DataFrame) -> DataFrame:
        """The lines (stored: read twice) whose key a filter holds: all shared ones and a few false positives.

        Lines meet their shard's filter in tasks of about PART_LINES; a shard with more is dealt out over several
        tasks, each with its own copy of the filter.
        """
        sharded = lines.withColumn("shard", self._shard())
        parts = sharded.groupBy("shard").agg(F.ceil(F.count("*") / PART_LINES).cast("int").alias("parts"))
        filters = stored(self.filters().join(parts, "shard"), "shard-parts")
        own = sharded.join(filters.select("shard", "parts"), "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "row", "pos"), F.col("parts")).cast("int"))
        copies = filters.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "buckets", "slots")
        dealt = own.select("shard", "part", "doc_id", "row", "pos", "h", "g").groupBy("shard", "part")
        return dealt.cogroup(copies.groupBy("shard", "part")).applyInPandas(passing, "doc_id long, row long, pos int, h long, g long")

    def dropped(self, docs: DataFrame) -> DataFrame:
        """doc_id, row, pos of every line that goes: its key is shared and the document is not the key's keeper."""
        return self._dropped(stored(keyed_lines(docs), "keyed-lines"))

    def _dropped(self, lines: DataFrame) -> DataFrame:
        shared = self.refs().where("n_docs > 1").select("h", "g", "keeper")
        return self.screened(lines).join(shared, ["h", "g"]).where("doc_id != keeper").select("doc_id", "row", "pos")

    def apply(self, docs: DataFrame) -> DataFrame:
        """All columns of ``docs`` with ``text`` reduced to the lines that stay, plus n_lines and n_dropped, which
        replace columns of those names."""
        out = self._reduced(docs, self.dropped(docs))
        return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in COUNTS], *[F.col(f"__{c}").alias(c) for c in COUNTS])

    @staticmethod
    def _reduced(docs: DataFrame, dropped: DataFrame) -> DataFrame:
        """All columns of ``docs`` with the text reduced, plus __n_lines and __n_dropped."""
        gone = dropped.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set("pos").alias("__gone"))
        whole = F.coalesce(F.col("text"), F.lit(""))
        text = F.when(F.col("__gone").isNotNull(), whole)
        kept = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.pandas_udf(without, "string")(text, F.col("__gone")))
        n_lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"))) + 1
        n_dropped = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone"))
        met = docs.join(gone, (F.col("doc_id") == F.col("__id")) & (row_mark(F.col("text")) == F.col("__row")), "left")
        columns = [kept.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
        return met.select(*columns, n_lines.cast("long").alias("__n_lines"), n_dropped.cast("long").alias("__n_dropped"))


COUNTS = ("n_lines", "n_dropped")


def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """The lines that stay, joined again; null where no line goes."""

    def kept(text: str | None, places: np.ndarray | None) -> str | None:
        if text is None:
            return None
        out = set(places.tolist())
        return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in out)

    return pd.Series([kept(t, g) for t, g in zip(texts, gone, strict=True)], dtype=object)


def passing(lines: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    """A part of one shard's lines that pass its filter."""
    names = ["doc_id", "row", "pos", "h", "g"]
    if not len(lines) or not len(own):
        return lines[names][:0]
    return lines.loc[CuckooFilter.load(int(own["buckets"].iloc[0]), own["slots"].iloc[0]).contains(lines["h"].to_numpy()), names]


def built(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter from its shared keys."""
    f = filled(rows["h"].to_numpy())
    return pd.DataFrame({"shard": [key[0]], "buckets": [f.buckets], "slots": [f.dump()]})


def changed(key: tuple, moves: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter after a change: keys that are shared no more go, newly shared ones come in."""
    if not len(old):
        f = CuckooFilter.sized(0)
    else:
        f = CuckooFilter.load(int(old["buckets"].iloc[0]), old["slots"].iloc[0], change=True)
    f.delete(moves.loc[moves["move"] < 0, "h"].to_numpy())
    fits = f.insert(moves.loc[moves["move"] > 0, "h"].to_numpy())
    return pd.DataFrame({"shard": [key[0]], "buckets": [f.buckets if fits else 0], "slots": [f.dump() if fits else b""]})


def reduced(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Inserts ``docs`` in a new index and takes their repeated lines out: all columns of ``docs`` as they came but
    for ``text``, plus __n_lines and __n_dropped. Lines are hashed once for both."""
    lines = stored(keyed_lines(docs), "keyed-lines")
    index = LineIndex(docs.sparkSession, path)._insert(lines)
    return index._reduced(docs, index._dropped(lines))


def dedup_lines(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Inserts ``docs`` in a new index and applies it to them.

    Null or empty text is one empty line. Rows without doc_id keep all lines. Rows that share a doc_id are one
    document to the reference counts, whatever their texts; each stays a row and loses the lines whose key a smaller
    doc_id holds. Ties go to the smallest doc_id. Very long texts are split in the row. An empty table gives an empty
    one. Other columns pass through; own columns named n_lines or n_dropped are replaced.
    """
    out = reduced(docs, path)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in COUNTS], *[F.col(f"__{c}").alias(c) for c in COUNTS])


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that stays, for every row; cases as in ``dedup_lines``."""
    out = dedup_lines(only(docs, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(generate_series(1, len(parts))) AS pos, unnest(parts) AS line, len(parts) AS n_lines
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, n_lines,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.doc_id, k.pos, k.line, k.n_lines, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, CAST(any_value(n_lines) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
