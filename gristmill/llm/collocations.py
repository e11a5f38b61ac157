"""Phrase mining by direct hashing and pruning: bucket counts of the next length, bitmaps to all tasks, exact counts.

Pass k counts phrases of k words exactly, and on the way counts phrases of k + 1 words in buckets. Between passes two
bitmaps are built and go to all tasks: buckets that reach the threshold, and hashes of phrases that are frequent. The
next pass counts a phrase only if both phrases of one word less that it holds are marked frequent (a priori) and its
own bucket is marked. Bitmaps only leave out what cannot be frequent: what passes is counted exactly and cut by its
count. Their size follows the text, up to MOST_BITS.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import bitmap, discard, looked_up, only, stored

LONGEST, LEAST, TOP = 4, 30, 2000
#: A phrase goes if a longer candidate that holds it has this share of its count, in hundredths.
COVERED = 80
SCORE = 2_000_000
#: Letters of text for each bucket, and bounds of the number of buckets as powers of two (bitmaps of 4 MB at most).
LETTERS, FEWEST_BITS, MOST_BITS = 128, 16, 25
#: Buckets of one stored block; tasks that rank a language's phrases; bytes of text whose words are held at once; rows
#: of counts that a task holds before it hands them on, and hands on at once.
BLOCK, SALTS, TEXT, HELD, ROWS_OUT = 1 << 16, 64, 1 << 20, 300_000, 50_000
SEED = 42
#: What each byte is: 0 part of a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
ROWS = "lang string, phrase string, hash long, n long, block int, counts binary"
NAMES = [c.split()[0] for c in ROWS.split(", ")]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 | 1)
    return h ^ (h >> np.uint64(29))


class Grams:
    """The words of a batch of texts, with hashes of the phrases that begin at each."""

    def __init__(self, langs: list[str], texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]  # a text's end is a piece's end
        kind = KIND[data]
        word = kind == 0
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        edge = np.r_[0, edge] if word[0] else edge
        start, end = edge[::2], edge[1::2]
        offsets = np.r_[0, np.cumsum(end - start)].astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[word]))
        known = words.dictionary_encode()
        self.code = known.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.words = known.dictionary
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), start).astype(np.int32)
        which, names = pd.factorize(np.array(langs, object))
        self.names = pa.array(names, pa.string())
        ends = np.cumsum([len(r) + 1 for r in raw])
        self.lang = which[np.searchsorted(ends, start, "right")].astype(np.int32)
        digest = lambda some: np.array([xxhash.xxh64_intdigest(s.encode(), SEED) for s in some] or [0], np.uint64)
        self.own = digest(self.words.to_pylist())[self.code] if len(start) else np.zeros(0, np.uint64)
        self.hashes = [mixed(self.own ^ digest(names)[self.lang] * np.uint64(3))]

    def hash(self, k: int) -> np.ndarray:
        """Of the k words from each place on; the last k - 1 places have none."""
        while len(self.hashes) < k:
            before, j = self.hashes[-1], len(self.hashes)
            self.hashes.append(mixed(before[: max(0, len(self.own) - j)] * np.uint64(5) + self.own[j:]))
        return self.hashes[k - 1]

    def inside(self, k: int) -> np.ndarray:
        """Places whose k words are of one piece."""
        n = max(0, len(self.piece) - k + 1)
        return self.piece[:n] == self.piece[len(self.piece) - n :] if n else np.zeros(0, bool)

    def counted(self, at: np.ndarray, k: int) -> pa.Table:
        """lang, phrase, hash and n of the distinct phrases of k words at these places."""
        key = self.lang[at].astype(np.int64)
        for j in range(k):
            key = pd.factorize(key * len(self.words) + self.code[at + j])[0]
        first = at[np.flatnonzero(np.diff(np.maximum.accumulate(key), prepend=-1) > 0)] if len(at) else at
        words = [self.words.take(pa.array(self.code[first + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if k > 1 else words[0]
        own = [self.names.take(pa.array(self.lang[first])), phrase.cast(pa.string()), pa.array(self.hash(k)[first].view(np.int64)), pa.array(np.bincount(key))]
        return pa.table(own, names=["lang", "phrase", "hash", "n"])


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of TEXT bytes of text, or of one longer text."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TEXT, "right")))
        yield batch.slice(a, b - a)
        a = b


def unpacked(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").view(bool)


def phrase_rows(docs: DataFrame, k: int, bits: int, least: int, longest: int, frequent: bytes | None, hot: bytes | None) -> DataFrame:
    """One pass over rows (lang, text), as ROWS: counts of phrases of k words that may be frequent, and (as blocks) how
    often each bucket of k + 1 words was met. The first pass also gives each language's number of words (no phrase)."""
    mask = np.uint64((1 << bits) - 1)

    def batch_of(size: int, /, **columns) -> pa.RecordBatch:
        kinds = dict(zip(NAMES, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in kinds.items()], names=NAMES)

    def handed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in t.combine_chunks().to_batches(ROWS_OUT):
            yield batch_of(len(b), **dict(zip(b.schema.names, b.columns, strict=True)))

    def merged(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["lang", "phrase", "hash"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = unpacked(frequent) if frequent else None
        met = unpacked(hot) if hot else None
        buckets = np.zeros(1 << bits if k < longest else 0, np.uint32)
        held: list[pa.Table] = []
        for part in itertools.chain.from_iterable(map(pieces, batches)):
            g = Grams(part.column(0).to_pylist(), part.column(1).to_pylist())
            ok = g.inside(k)
            at = np.flatnonzero(ok)
            if k > 1:
                sure = seen[g.hash(k - 1) & mask]
                at = at[sure[at] & sure[at + 1]]
                at = at[met[g.hash(k)[at] & mask]]
                ok = np.zeros(len(ok), bool)
                ok[at] = True
            else:
                yield batch_of(len(g.names), lang=g.names, n=np.bincount(g.lang, minlength=len(g.names)))
            held.append(g.counted(at, k))
            if sum(map(len, held)) > HELD:
                held = [merged(held)]
                if len(held[0]) > HELD // 2:
                    yield from handed(held[0])
                    held = []
            if k < longest:
                more = g.inside(k + 1)
                more &= ok[: len(more)] & ok[1 : len(more) + 1]
                np.add.at(buckets, (g.hash(k + 1)[more] & mask).astype(np.int64), np.uint32(1))
        if held:
            yield from handed(merged(held))
        del held
        pa.default_memory_pool().release_unused()
        packer = zstandard.ZstdCompressor(level=1)
        for b, a in enumerate(range(0, len(buckets), BLOCK)):
            own = np.minimum(buckets[a : a + BLOCK], least)  # more than the threshold need not be told apart
            if own.any():
                yield batch_of(1, block=[b], counts=[packer.compress(own.astype(np.uint8 if least < 256 else np.uint32).tobytes())])

    return docs.mapInArrow(run, ROWS)


def hot_buckets(rows: DataFrame, bits: int, least: int) -> bytes:
    """The bitmap of buckets that were met ``least`` times. Each task adds up the blocks that are dealt to it, one by
    one as they come."""
    kind, size = (np.uint8, 1) if least < 256 else (np.uint32, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for b, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = np.frombuffer(opener.decompress(counts, BLOCK * size), kind)
                own[b] = np.minimum(own[b] + now, least).astype(np.int64) if b in own else now.astype(np.int64)
        done = {b: np.packbits(v >= least, bitorder="little").tobytes() for b, v in own.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int32()), pa.array(list(done.values()), pa.binary())], names=["block", "bits"])

    blocks = max(1, (1 << bits) // BLOCK)
    out = np.zeros((1 << bits) // 8, np.uint8)
    dealt = rows.where("block is not null").select("block", "counts").repartition(min(blocks, 64), "block")
    for r in dealt.mapInArrow(run, "block int, bits binary").collect():  # at most 1 << bits bits
        own = np.frombuffer(r["bits"], np.uint8)
        out[r["block"] * BLOCK // 8 :][: len(own)] = own
    return out.tobytes()


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of all phrases of up to ``longest`` words with a >= least, and (lang, n): the number of
    words. ``docs``: lang (not null) and text."""
    letters = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(FEWEST_BITS, (letters // LETTERS).bit_length()))
    frequent = hot = out = totals = None
    for k in range(1, longest + 1):
        rows = stored(phrase_rows(docs, k, bits, least, longest, frequent, hot), f"phrases-{k}", "zstd")
        if k == 1:
            totals = stored(rows.where("block is null and phrase is null").groupBy("lang").agg(F.sum("n").alias("n")), "words")
        sums = rows.where("phrase is not null").groupBy("lang", "phrase", "hash").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        own = stored(sums.withColumn("size", F.lit(k)), f"frequent-{k}")
        if k < longest:
            frequent, hot = bitmap(own.select("hash"), bits), hot_buckets(rows, bits, least)
        discard(rows)
        out = own if out is None else out.unionByName(own)
    return out.select("lang", "phrase", "size", "a"), totals


def dice(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(SCORE * a / (l + r)), exactly: the product of numbers of any 64 bits has 38 digits' room."""
    wide = lambda c, p: c.cast(f"decimal({p},0)")
    product, whole = wide(a, 20) * wide(F.lit(SCORE), 7), wide(l, 20) + wide(r, 20)
    return F.call_function("div", product, whole).cast("long")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of phrases of two words or more, at their lowest-scoring cut."""
    words = F.split("phrase", " ", -1)
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(F.struct(k.alias("cut"), F.lit(0).alias("side"), part(F.lit(1), k).alias("part")), F.struct(k.alias("cut"), F.lit(1).alias("side"), part(k + 1, F.col("size") - k).alias("part"))))
    asked = phrases.where("size > 1").select("lang", "phrase", "size", "a", F.inline(F.flatten(cuts)))
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    own = looked_up(asked, counts, ["lang", "part"]).repartition("lang", "phrase")
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("f")))
    each = own.groupBy("lang", "phrase", "size", "a", "cut").agg(side(0).alias("l"), side(1).alias("r"))
    best = each.withColumn("score", dice(F.col("a"), F.col("l"), F.col("r"))).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """Candidates (lang, phrase, size, a) that no longer candidate holds and covers."""
    words = F.split("phrase", " ", -1)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    held = candidates.where("size > 2").select("lang", F.col("a").alias("over"), F.explode(spans).alias("phrase"))
    most = held.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("over").isNull() | (wide("over") * 100 < wide("a") * covered)).drop("over")


def collocation_report(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases.

    Null text is empty and null lang is ``und``; an empty lang is one of its own. Rows that share an id or a text count
    each for itself; texts without words and empty tables give no rows; other columns are not looked at. Texts are
    read whole: a text is held by one task, some 60 bytes a word.
    """
    own = only(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    phrases, totals = frequent_phrases(own)
    phrases = stored(phrases, "frequent")
    left = uncovered(scored(phrases))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")
    first = left.select("*", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    kept = ranked.join(totals, "lang")
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents WHERE text IS NOT NULL),
pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM texts)),
grams AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
    FROM pieces, unnest(range(1, {LONGEST + 1})) AS u(k)) GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE f >= {LEAST}),
parts AS MATERIALIZED (
  SELECT lang, phrase, f AS a, j, array_to_string(w[1 : j], ' ') AS left_part, array_to_string(w[j + 1 : k], ' ') AS right_part
  FROM frequent, unnest(range(1, {LONGEST})) AS u(j) WHERE j < k),
cuts AS (
  SELECT p.*, l.f AS l, r.f AS r, CAST({SCORE}::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score
  FROM parts p JOIN frequent l ON l.lang = p.lang AND l.phrase = left_part
  JOIN frequent r ON r.lang = p.lang AND r.phrase = right_part),
best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
covers AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, f, unnest(list_transform(range(1, k - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS phrase
    FROM frequent, unnest(range(2, {LONGEST})) AS u(n) WHERE n < k) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN covers c USING (lang, phrase) WHERE c.f IS NULL OR 100 * c.f::HUGEINT < {COVERED} * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
  n::BIGINT AS n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= {TOP}"""
