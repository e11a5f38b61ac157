"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only lengths decide where a piece goes, and there are at most ``capacity`` of them: a histogram of all lengths is
all that the plan needs, whatever the size of the corpus. The plan is made on that histogram in three steps.

1. Large items (above a third of the capacity; two of them at most fit in a bin) are matched greedily: the largest
   takes the largest other one that still fits beside it.
2. Smaller items, in falling length, go best-fit into the smallest gap that holds them; only then new bins open.
3. Bins of one shape are one entry with a count, so that a step moves whole counts and not single pieces.

Each piece then gets its rank among those of its length (numbered within salted groups, whose offsets are summed
up beforehand), and the rank alone tells its bin and offset. The plan has a row for each run of equal slots.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import mapped, only, stored
from gristmill.llm.tokens import Tokens

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Groups that the pieces of one length are numbered in, at least, and pieces of a group where that takes more groups.
SALTS, SALT_PIECES = 64, 200_000


class Plan:
    """Where the pieces of each length go: runs of slots, from a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        #: gap -> bins of one shape: [number of bins, ((length, copies), ...)]
        self.open: dict[int, list[list]] = defaultdict(list)
        self.gaps: list[int] = []
        left = {n: c for n, c in histogram.items() if c > 0}
        self._match({n: left[n] for n in left if 3 * n > capacity})
        for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
            self._fill(n, left[n])

    def _put(self, gap: int, bins: int, shape: tuple) -> None:
        if not self.open[gap]:
            bisect.insort(self.gaps, gap)
        self.open[gap].append([bins, shape])

    def _match(self, large: dict[int, int]) -> None:
        lengths, left = sorted(large), dict(large)
        while lengths:
            n = lengths[-1]
            k = bisect.bisect_right(lengths, self.capacity - n) - 1
            if k < 0:
                self._put(self.capacity - n, left.pop(n), ((n, 1),))
                lengths.pop()
                continue
            m = lengths[k]
            bins = left[n] // 2 if m == n else min(left[n], left[m])
            if not bins:  # a single one is left of a length that fits beside itself only
                if k:
                    m, bins = lengths[k - 1], 1
                else:
                    self._put(self.capacity - n, left.pop(n), ((n, 1),))
                    lengths.pop()
                    continue
            self._put(self.capacity - n - m, bins, ((n, 2),) if m == n else ((n, 1), (m, 1)))
            for x in (n, m):
                left[x] -= bins
            for x in {n, m}:
                if not left[x]:
                    del left[x]
                    lengths.remove(x)

    def _fill(self, n: int, count: int) -> None:
        while count:
            k = bisect.bisect_left(self.gaps, n)
            if k == len(self.gaps):
                copies = self.capacity // n
                if full := count // copies:
                    self._put(self.capacity - copies * n, full, ((n, copies),))
                if rest := count % copies:
                    self._put(self.capacity - rest * n, 1, ((n, rest),))
                return
            gap = self.gaps[k]
            bins, shape = self.open[gap][-1]
            copies = gap // n
            used = min(bins, count // copies)
            if used:
                self._take(gap, used)
                self._put(gap - copies * n, used, (*shape, (n, copies)))
                count -= used * copies
            else:
                self._take(gap, 1)
                self._put(gap - count * n, 1, (*shape, (n, count)))
                count = 0

    def _take(self, gap: int, bins: int) -> None:
        own = self.open[gap]
        own[-1][0] -= bins
        if not own[-1][0]:
            own.pop()
            if not own:
                self.gaps.remove(gap)

    def slots(self) -> pd.DataFrame:
        """length, rank (first of the run), copies (in a bin), bin (first of the run), offset; ordered by length and rank."""
        rows, bin_, ranks = [], 0, defaultdict(int)
        for gap in sorted(self.open):
            for bins, shape in self.open[gap]:
                offset = 0
                for n, copies in shape:
                    rows.append((n, ranks[n], copies, bin_, offset))
                    ranks[n] += bins * copies
                    offset += n * copies
                bin_ += bins
        out = pd.DataFrame(rows, columns=["length", "rank", "copies", "bin", "offset"], dtype=np.int64)
        return out.sort_values(["length", "rank"], ignore_index=True)

    def bins(self) -> int:
        return sum(b for own in self.open.values() for b, _ in own)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as token ids with the end id, cut if longer than the capacity.

    Null text is empty: one piece of the end id alone.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(tokenizer)
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = np.append(tokens.ids(text), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInPandas(run, PIECES)


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (any frame with doc_id, piece and length, stored: it is read twice) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    salts = [max(SALTS, -(-histogram.get(n, 0) // SALT_PIECES)) for n in range(capacity + 1)]
    of_length = F.get(F.array(*[F.lit(n) for n in salts]), F.col("length").cast("int"))
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), of_length).cast("int"))
    groups = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    counts = groups.orderBy("length", "__salt").toPandas()  # a row for each SALT_PIECES pieces, plus capacity * SALTS
    counts["__first"] = counts.groupby("length")["n"].cumsum() - counts["n"]
    plan = Plan(histogram, capacity)
    slots = plan.slots()
    spark = parts.sparkSession
    first = spark.sparkContext.broadcast({(r.length, getattr(r, "salt")): r.first for r in counts.rename(columns={"__salt": "salt", "__first": "first"}).itertuples()})
    place = spark.sparkContext.broadcast({k: slots[k].to_numpy() for k in slots})
    numbered = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")).cast("long") - 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = place.value
        keys = at["length"] * (1 << 45) + at["rank"]
        for frame in frames:
            n, salt = frame["length"].to_numpy(), frame["__salt"].to_numpy()
            rank = frame["__rank"].to_numpy() + np.array([first.value[x] for x in zip(n.tolist(), salt.tolist(), strict=True)], np.int64)
            k = np.searchsorted(keys, n * (1 << 45) + rank, side="right") - 1
            inside = rank - at["rank"][k]
            yield frame.assign(sequence_id=at["bin"][k] + inside // at["copies"][k], offset=at["offset"][k] + inside % at["copies"][k] * n)

    return mapped(numbered, run, "sequence_id long, offset long").drop("__salt", "__rank")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document.

    Sequence numbers run from 0 without gaps. Null text is empty: the end id alone. Rows that share a doc_id, and rows
    without one, are packed as documents of their own; pieces of one length are alike to the plan. Very long texts are
    cut into pieces, never shortened. An empty table gives an empty result; other columns are not looked at.
    """
    return packed(stored(pieces(docs, tokenizer, capacity), "pieces"), capacity)
