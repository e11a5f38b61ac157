"""Benchmark decontamination with suffix arrays over the training text.

The corpus is indexed once: each task turns its documents into shards of bounded size, a sequence of numbered words
with the full suffix array (sorted to the documents' ends by prefix doubling), and stores them in the shared folder.
A document lies in one shard as a whole, so that nothing is shuffled. Test items go to the tasks in blocks of bounded
size, one block after the other over the stored shards. In each shard every suffix of an item that is long enough for
a window is found by binary search; what lies between its two bounds are all places of the window, and runs of windows
on one diagonal (the same distance between place in the document and place in the item) are the longest verbatim
matches with their locations in both.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import looked_up, only, stored

WINDOW = 10
#: Bytes of test text that go to the tasks at once; a larger benchmark is gone through in several blocks.
BLOCK_BYTES = 16 << 20
#: Characters of a shard; a longer document is a shard of its own.
SHARD_CHARACTERS = 3_000_000
#: Windows that are looked for at once: a worker's memory does not grow with the block's.
ASKED = 1 << 16
#: Words are runs of digits, a-z and characters beyond ASCII; A-Z is lower-cased before.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
VERDICT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if isinstance(text, str) else []


INDEX = "doc_ids array<long>, rows array<long>, starts array<int>, lengths array<int>, vocabulary binary, ids binary, suffixes binary"
FOUND = "doc_id long, row long, spans array<struct<a:int,b:int>>, lists array<string>"
#: Items that own the same windows: named by a mark, so that documents carry marks and not what may be all items.
LISTS = "list string, names array<string>"
MATCHES = "doc_id long, item_id string, start long, item_start long, item_windows long, length long"


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by prefix doubling: only suffixes that are still tied are sorted again."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    at, key, k = np.arange(n), ids[order].astype(np.int64), 1
    while True:
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(first, len(key)))
        rank[order[at]] = np.repeat(at[first], sizes)
        at = at[np.repeat(sizes > 1, sizes)]
        if not len(at):
            return order
        places = order[at]
        after = np.where(places + k < n, rank[np.minimum(places + k, n - 1)] + 1, 0)
        key = rank[places] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        order[at], key, k = places[by], key[by], 2 * k


class ItemBlock:
    """The windows of some test items, as numbered words, with the items and places that each stands at."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [i for i, _ in items]
        number = {name: k for k, name in enumerate(sorted(set(self.names)))}
        of_item = np.array([number[i] for i in self.names], np.int64)
        own = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)], np.int32) for _, text in items]
        #: marks and names of the distinct lists of items that own a window; per length the list of each window
        self.marks: list[str] = []
        self.lists: list[list[str]] = []
        self.list_of: dict[int, np.ndarray] = {}
        #: per length of a window: its windows as rows of numbers, and how many owners (item, place) each has
        self.windows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        numbers: dict[tuple[int, ...], int] = {}
        for length in sorted({min(len(x), window) for x in own} - {0}):
            which = [n for n, x in enumerate(own) if len(x) == length or len(x) > length == window]
            counts = [len(own[n]) - length + 1 for n in which]
            owners = np.stack([np.repeat(np.array(which, np.int32), counts), np.concatenate([np.arange(c, dtype=np.int32) for c in counts])], 1)
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(own[n], length) for n in which])
            order = np.lexsort(rows.T[::-1])
            rows, owners = rows[order], owners[order]
            new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))
            first = np.flatnonzero(new)
            self.windows.append((length, rows[first], np.append(first, len(rows)), owners))
            # Distinct items of each window; most have one, only the others are gone through one by one.
            held = np.unique((np.cumsum(new) - 1) * len(number) + of_item[owners[:, 0]])
            window_of, item_of = np.divmod(held, len(number))
            begin = np.searchsorted(window_of, np.arange(len(first) + 1))
            single, lists = np.diff(begin) == 1, np.zeros(len(first), np.int64)
            names, at = np.unique(item_of[begin[:-1][single]], return_inverse=True)
            lists[single] = np.array([numbers.setdefault((k,), len(numbers)) for k in names.tolist()], np.int64)[at]
            for w in np.flatnonzero(~single).tolist():
                lists[w] = numbers.setdefault(tuple(item_of[begin[w] : begin[w + 1]].tolist()), len(numbers))
            self.list_of[length] = lists
        names = sorted(number)
        for x in numbers:
            self.lists.append([names[k] for k in x])
            self.marks.append(hashlib.sha256("".join(f"{len(i)}:{i}" for i in self.lists[-1]).encode("utf-8", "surrogatepass")).hexdigest()[:32])


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of n numbers from first on: which run each number is of, and the numbers."""
    which = np.repeat(np.arange(len(n)), n)
    return which, first[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Shard:
    """Documents as one sequence of word numbers with its suffix array."""

    def __init__(self, vocabulary: list[bytes], ids: np.ndarray, suffixes: np.ndarray, starts: np.ndarray):
        self.numbers = {w: k for k, w in enumerate(vocabulary)}
        self.ids, self.suffixes, self.starts = ids, suffixes, starts

    @staticmethod
    def build(texts: list[str | None]) -> tuple[Shard, np.ndarray]:
        """The shard, and the documents' numbers of words."""
        numbers: dict[bytes, int] = {}
        own = [np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)], np.int64) for t in texts]
        lengths = np.array([len(x) for x in own], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1].astype(np.int64)
        # Each document ends with a number of its own, where any match and any tie ends.
        ids = np.concatenate([y for k, x in enumerate(own) for y in (x, np.array([len(numbers) + k]))] or [np.zeros(0, np.int64)])
        return Shard(list(numbers), ids, suffix_array(ids), starts), lengths

    def row(self, doc_ids: list, marks: list, lengths: np.ndarray) -> tuple:
        pack = lambda x: x.astype("<i4").tobytes()
        return doc_ids, marks, self.starts.tolist(), lengths.tolist(), b" ".join(self.numbers), pack(self.ids), pack(self.suffixes)

    @staticmethod
    def load(vocabulary: bytes, ids: bytes, suffixes: bytes, starts: np.ndarray) -> Shard:
        return Shard(vocabulary.split(), np.frombuffer(ids, "<i4"), np.frombuffer(suffixes, "<i4"), np.asarray(starts, np.int64))

    def _bound(self, queries: np.ndarray, after: bool) -> np.ndarray:
        """The first suffix that does not come before a query, or (after) the first that comes after all it begins."""
        depth, n = queries.shape[1], len(self.suffixes)
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), n, np.int64)
        steps, last = np.arange(depth), len(self.ids) - 1
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            seen = self.ids[np.minimum(self.suffixes[mid][:, None] + steps, last)]
            asked = queries[open_]
            differ = seen != asked
            first = differ.argmax(1)
            k = np.arange(len(open_))
            less = np.where(differ.any(1), seen[k, first] < asked[k, first], after)
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        return low

    def _met(self, own: np.ndarray, windows: np.ndarray, a: int, b: int) -> np.ndarray:
        """Those of the windows from a to b that are there, with the bounds of their suffixes: three rows of numbers."""
        queries = own[windows[a:b]]
        asked = np.flatnonzero((queries >= 0).all(1))
        low = self._bound(queries[asked], False)
        begins = self.suffixes[np.minimum(low, len(self.suffixes) - 1)]
        there = (low < len(self.suffixes)) & (self.ids[np.minimum(begins[:, None] + np.arange(windows.shape[1]), len(self.ids) - 1)] == queries[asked]).all(1)
        asked, low = asked[there], low[there]
        return np.stack([a + asked, low, self._bound(queries[asked], True)])

    def found(self, block: ItemBlock) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per window length: the length, the places of windows, the window of each place, and the windows' owners."""
        own = np.array([self.numbers.get(w, -1) for w in block.vocabulary], np.int64)
        for length, windows, first_owner, owners in block.windows:
            parts = [self._met(own, windows, a, min(a + ASKED, len(windows))) for a in range(0, len(windows), ASKED)] if len(self.ids) >= length else []
            asked, low, high = np.concatenate([np.zeros((3, 0), np.int64), *parts], axis=1)
            which, at = spread(low, high - low)
            yield length, self.suffixes[at].astype(np.int64), asked[which], first_owner, owners

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def row_mark(text: Column) -> Column:
    """Tells rows of one doc_id apart; rows with the same text have the same matches."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def suffix_index(docs: DataFrame) -> DataFrame:
    """The stored shards (INDEX) of ``docs``, one row each. Null text has no words; every row is in one shard."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            for row in zip(frame["doc_id"], frame["row"], frame["text"], strict=True):
                held.append(row)
                size += len(row[2]) if isinstance(row[2], str) else 0
                if size >= SHARD_CHARACTERS:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    def made(held: list[tuple]) -> pd.DataFrame:
        shard, lengths = Shard.build([t for _, _, t in held])
        ids = [None if pd.isna(d) else int(d) for d, _, _ in held]
        return pd.DataFrame([shard.row(ids, [int(r) for _, r, _ in held], lengths)], columns=[c.split()[0] for c in INDEX.split(", ")])

    own = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), row_mark(F.col("text")).alias("row"), "text")
    return stored(own.mapInPandas(run, INDEX), "suffix-arrays", large_rows=True)


def item_blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[ItemBlock]:
    own = only(items, "item_id", "text").where("item_id is not null and text is not null")
    total = own.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    part = own.select(F.col("item_id").cast("string").alias("item_id"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("part"))
    for k in range(n):
        yield ItemBlock([(r["item_id"], r["text"]) for r in part.where(F.col("part") == k).collect()], window)


def searched(index: DataFrame, items: DataFrame, window: int, block_bytes: int, rows: str, ask: Callable, keep: Callable | None = None) -> DataFrame:
    """What ``ask(shard, block, doc_ids, marks)`` gives for each stored shard and block of items. A block's results are
    written before the next block goes out, so that one block at a time is held; ``keep`` is called with each."""
    spark, out, names = index.sparkSession, None, re.findall(r"(?:^|, )(\w+) ", rows)
    for b in item_blocks(items, window, block_bytes):
        if keep:
            keep(b)
        block = spark.sparkContext.broadcast(b)

        def run(frames: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples():
                    shard = Shard.load(r.vocabulary, r.ids, r.suffixes, r.starts)
                    yield pd.DataFrame(ask(shard, block.value, r.doc_ids, r.rows), columns=list(names))

        found = stored(only(index, *[c.split()[0] for c in INDEX.split(", ")]).mapInPandas(run, rows), "found")
        block.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def hits(shard: Shard, block: ItemBlock, doc_ids: np.ndarray, marks: np.ndarray) -> list[tuple]:
    """FOUND of one shard: for each document with windows the words inside them as spans, and the lists of items that
    own those windows. A window that all items share is one list, whatever their number."""
    edge, owned = np.zeros(len(shard.ids) + 1, np.int64), []
    for length, places, which, _, _ in shard.found(block):
        np.add.at(edge, places, 1)
        np.add.at(edge, places + length, -1)
        owned.append(np.unique(np.stack([shard.document(places), block.list_of[length][which]], 1), axis=0))
    inside = np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8), [0]))
    begins, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    spans: dict[int, list] = {}
    for d, a, b in zip(shard.document(begins).tolist(), begins.tolist(), ends.tolist(), strict=True):
        spans.setdefault(d, []).append({"a": a - int(shard.starts[d]), "b": b - int(shard.starts[d])})
    lists: dict[int, list] = {}
    for d, n in np.unique(np.concatenate(owned), axis=0).tolist() if owned else ():
        lists.setdefault(d, []).append(block.marks[n])
    return [(None if pd.isna(doc_ids[d]) else int(doc_ids[d]), int(marks[d]), spans[d], sorted(lists[d])) for d in spans]


def longest(shard: Shard, block: ItemBlock, doc_ids: np.ndarray, marks: np.ndarray) -> list[tuple]:
    """MATCHES of one shard: runs of windows on one diagonal of a document and an item."""
    rows = []
    for length, places, which, first_owner, owners in shard.found(block):
        at, k = spread(first_owner[which], first_owner[which + 1] - first_owner[which])
        docs, own = shard.document(places[at]), owners[k]
        start = places[at] - shard.starts[docs]
        each = np.unique(np.stack([docs, own[:, 0], start - own[:, 1], start], 1), axis=0)
        first = np.flatnonzero(np.concatenate(([True], (np.diff(each[:, :3], axis=0) != 0).any(1) | (np.diff(each[:, 3]) != 1)))) if len(each) else ()
        for (d, n, diagonal, a), count in zip(each[first].tolist() if len(each) else (), np.diff(np.append(first, len(each))).tolist() if len(each) else (), strict=True):
            rows.append((None if pd.isna(doc_ids[d]) else int(doc_ids[d]), block.names[n], a, a - diagonal, count, count + length - 1))
    return rows


def verdicts(docs: DataFrame, items: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """doc_id, row and VERDICT of every row of ``docs``."""
    index, spark, tables = suffix_index(docs), docs.sparkSession, []
    keep = lambda b: tables.append(stored(spark.createDataFrame(list(zip(b.marks, b.lists, strict=True)), LISTS), "owner-lists"))
    found = searched(index, items, window, block_bytes, FOUND, hits, keep)
    edges = F.sort_array(F.flatten(F.collect_list("spans")))
    merged = F.aggregate(  # words inside any span: spans in order, each counted from where the last one ended
        edges,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, e: F.struct((s["n"] + F.greatest(F.lit(0), e["b"] - F.greatest(e["a"], s["end"]))).cast("long").alias("n"), F.greatest(e["b"], s["end"]).alias("end")),
        lambda s: s["n"],
    )
    lists = F.sort_array(F.array_distinct(F.flatten(F.collect_list("lists"))))
    each = found.distinct().groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(merged.alias("n_hit"), lists.alias("lists"))
    each = stored(each.withColumn("combined", F.sha2(F.concat_ws(",", "lists"), 256)), "hit-documents")
    told = looked_up(each.select("__id", "__row", "n_hit", "combined"), combined_lists(each, reduce(DataFrame.unionByName, tables)), ["combined"])
    every = index.select(F.explode(F.arrays_zip("doc_ids", "rows", "lengths")).alias("d")).select("d.doc_ids", "d.rows", "d.lengths")
    met = every.join(told, F.col("doc_ids").eqNullSafe(F.col("__id")) & (F.col("rows") == F.col("__row")), "left")
    return met.select(
        F.col("doc_ids").alias("doc_id"), F.col("rows").alias("row"), F.col("lengths").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def combined_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """(combined, n_items, items_sha256) of each distinct combination of lists: items are named once for a combination
    and not once for a document."""
    distinct = rows.select("combined", "lists").dropDuplicates(["combined"]).select("combined", F.explode("lists").alias("list"))
    named = looked_up(distinct, lists.dropDuplicates(["list"]), ["list"]).select("combined", F.explode("names").alias("name"))
    all_ = named.groupBy("combined").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return all_.select("combined", F.size("names").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "names"), 256).alias("items_sha256"))


def judged(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` (own ones of the same names replaced) with n_words, n_hit, n_items, items_sha256 and contaminated.

    Null text has no words; a null item_id or item text no windows; repeated rows and items change nothing for
    the others. Windows that several items have count for each of them. Very long texts are indexed whole. Empty
    tables give an empty result, or one without hits.
    """
    found = verdicts(docs, items, window, block_bytes).dropDuplicates(["doc_id", "row"]).withColumnRenamed("doc_id", "__id").withColumnRenamed("row", "__row")
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (row_mark(F.col("text")) == F.col("__row"))
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in VERDICT])
    return base.join(found, here).select(*[F.col(f"`{c}`") for c in base.columns], *VERDICT)


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """MATCHES: the longest verbatim matches with their places in the document and in the item, in words.

    Windows that follow each other in the document and in the item belong to one match. Cases as in ``judged``.
    """
    return searched(suffix_index(docs), items, window, block_bytes, MATCHES, longest)


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any word inside a window of a test item; columns as they came, whatever they are called.
    Cases as in ``judged``; a document without words stays."""
    found = searched(suffix_index(docs), items, window, block_bytes, FOUND, hits).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"))
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (row_mark(F.col("text")) == F.col("__row"))
    return docs.join(found, here, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and VERDICT of every row; cases as in ``judged``."""
    return verdicts(docs, items, WINDOW, BLOCK_BYTES).drop("row")
