"""Edit-aware token counts: stored segment trees over each document's pre-token segments.

A text is cut into segments at places where a pre-token ends whatever stands further away, so that the counts of
segments add up to the tokenizer's count of the whole text. A segment tree holds characters and tokens of every
subtree. ``build`` encodes a corpus once and keeps its trees as a table; ``apply_edits`` reads the trees of edited
documents, descends to the segments that an edit touches, takes in neighbours whose border is no safe cut any more,
encodes just that region again, cuts it anew and updates the sums on the way up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import only, stored
from gristmill.llm.tokens import Tokens

#: Characters that a segment has at least, if the text has safe cuts.
SEGMENT = 240
EDITS = "array<struct<at:long,n_deleted:long,inserted:string>>"
TREES = "doc_id long, text string, chars array<int>, counts array<int>"
COUNTS = "n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, n_reencoded long"
#: Letters and marks that every version of the tokenizer's pattern classes alike (no apostrophe: it begins "'s").
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u03b1-\u03c9\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
MARK = "!-&(-/:-@\\[-`{-~\u2013\u2014\u2026\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
#: A place where a pre-token ends: before white space that follows none, and where letters, digits and marks meet. No
#: pre-token runs over such a place, and none before it looks beyond it.
CUT = re.compile(
    rf"(?<=[{LETTER}{MARK}'0-9])(?=[ \t-\r])|(?<=[{LETTER}])(?=[{MARK}0-9])|(?<=[0-9])(?=[{LETTER}{MARK}])|(?<=[{MARK}])(?=[{LETTER}0-9])"
)


def safe(left: str, right: str, special: list[str]) -> bool:
    """Whether a text may be cut between these two parts of it: a safe place, and not within a special token."""
    a, b = left[-64:], right[:64]
    if not CUT.search(a[-1:] + b[:1], len(a[-1:])):
        return False
    return not any(s in a[-len(s) + 1 :] + b[: len(s) - 1] for s in special if len(s) > 1)


def segments(text: str, special: list[str] = ()) -> list[str]:
    out, start, k = [], 0, SEGMENT
    while (m := CUT.search(text, k)) and (k := m.start()) < len(text):
        if not special or safe(text[max(0, k - 64) : k], text[k : k + 64], special):
            out.append(text[start:k])
            start, k = k, k + SEGMENT
        else:
            k += 1
    return [*out, text[start:]]


class CountTree:
    """One document's text with the tree of (characters, tokens) sums over its segments, as two heaps: node 1 is the
    root, node k has children 2 k and 2 k + 1, the leaves are the second half."""

    def __init__(self, text: str, tokens: Tokens, chars: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.whole, self.tokens, self.reencoded = text, tokens, 0
        if chars is None:
            parts = segments(text, tokens.special)
            self._leaves([len(p) for p in parts], [self._count(p) for p in parts])
        else:
            self.chars, self.counts, self.size = np.array(chars, np.int64), np.array(counts, np.int64), len(chars) // 2

    def _count(self, part: str) -> int:
        return len(self.tokens.encode(part)) if part else 0

    def _leaves(self, chars: list[int], counts: list[int]) -> None:
        self.size = 1 << max(0, len(chars) - 1).bit_length()
        self.chars, self.counts = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        for heap, own in ((self.chars, chars), (self.counts, counts)):
            heap[self.size : self.size + len(own)] = own
            at = self.size
            while at > 1:
                heap[at // 2 : at] = heap[at : 2 * at : 2] + heap[at + 1 : 2 * at : 2]
                at //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.counts[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return self.whole

    def _find(self, at: int) -> tuple[int, int]:
        """Segment that holds the place, and the place within it; the end belongs to the last that has text."""
        k = 1
        while k < self.size:
            k *= 2
            if at >= self.chars[k] and self.chars[k + 1]:
                at, k = at - int(self.chars[k]), k + 1
        return k - self.size, at

    def _set(self, i: int, chars: int, count: int) -> None:
        k = i + self.size
        self.chars[k], self.counts[k] = chars, count
        while k := k // 2:
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.counts[k] = self.counts[2 * k] + self.counts[2 * k + 1]

    def _next(self, i: int, step: int) -> int | None:
        """The nearest segment with text on that side."""
        i += step
        while 0 <= i < self.size:
            if self.chars[i + self.size]:
                return i
            i += step
        return None

    def edit(self, at: int, n_deleted: int, inserted: str | None) -> None:
        """Deletes characters at a place and inserts others there; places beyond the ends are cut off."""
        at = min(max(0, at), self.n_chars)
        end = min(at + max(0, n_deleted), self.n_chars)
        first, inside = self._find(at)
        last, stop = self._find(end) if end > at else (first, inside)
        a, b = at - inside, end - stop + int(self.chars[last + self.size])
        region = self.whole[a:at] + (inserted or "") + self.whole[end:b]
        # Context: a neighbour comes in while the border to it is no safe cut.
        special = self.tokens.special
        while (i := self._next(first, -1)) is not None and not (region and safe(self.whole[max(0, a - 64) : a], region, special)):
            first, a, region = i, a - int(self.chars[i + self.size]), self.whole[a - int(self.chars[i + self.size]) : a] + region
        while (i := self._next(last, 1)) is not None and not (region and safe(region, self.whole[b : b + 64], special)):
            last, b, region = i, b + int(self.chars[i + self.size]), region + self.whole[b : b + int(self.chars[i + self.size])]
        self.whole = self.whole[:a] + region + self.whole[b:]
        self.reencoded += len(region)
        parts = segments(region, special)
        chars, counts = [len(p) for p in parts], [self._count(p) for p in parts]
        if len(parts) <= last - first + 1:
            for i in range(first, last + 1):
                k = i - first
                self._set(i, *((chars[k], counts[k]) if k < len(parts) else (0, 0)))
        else:  # more segments than before: the tree is laid out anew, nothing is encoded for that
            own, n = [self.chars[self.size :].tolist(), self.counts[self.size :].tolist()], self.size
            new = [x[:first] + y + x[last + 1 : n] for x, y in zip(own, (chars, counts), strict=True)]
            kept = [k for k, c in enumerate(new[0]) if c] or [0]
            self._leaves([new[0][k] for k in kept], [new[1][k] for k in kept])


def build(docs: DataFrame, tokenizer: str, *also: str) -> DataFrame:
    """The stored trees (TREES) of ``docs``, one for each row, with the columns named in ``also``; null text is empty.
    This encodes every text once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(tokenizer)
        for frame in frames:
            trees = [CountTree(t if isinstance(t, str) else "", tokens) for t in frame["text"]]
            own = {"text": [t.whole for t in trees], "chars": [t.chars for t in trees], "counts": [t.counts for t in trees]}
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"), **own)

    own = only(docs, "doc_id", "text", *also).withColumn("doc_id", F.col("doc_id").cast("long"))
    more = "".join(f", {c} {own.schema[c].dataType.simpleString()}" for c in also)
    return stored(own.mapInPandas(run, TREES + more), "token-trees", "zstd")


def with_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows (documents or trees) with the column ``edits`` from rows (doc_id, seq, at, n_deleted, inserted), in the
    order of seq; rows that share a doc_id are edited alike."""
    each = edits.groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_list(F.struct("seq", "at", "n_deleted", "inserted"))).alias("__all"))
    own = F.transform("__all", lambda e: F.struct(e["at"].cast("long").alias("at"), e["n_deleted"].cast("long").alias("n_deleted"), e["inserted"].alias("inserted")))
    return rows.drop("edits").join(each, F.col("doc_id") == F.col("__id"), "left").withColumn("edits", own).drop("__id", "__all")


def apply_edits(trees: DataFrame, tokenizer: str, trees_too: bool = True) -> DataFrame:
    """COUNTS (and TREES, as they are after the edits) of rows with TREES and ``edits`` (EDITS; null or empty: none).

    Only edited documents go to Python, and of those only the regions that edits touch are encoded.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(tokenizer)
        for frame in frames:
            rows = []
            for doc_id, text, chars, counts, edits in frame[["doc_id", "text", "chars", "counts", "edits"]].itertuples(index=False):
                tree = CountTree(text, tokens, chars, counts)
                before = tree.n_tokens
                for e in edits:
                    tree.edit(int(e["at"] or 0), int(e["n_deleted"] or 0), e["inserted"])
                own = (before, len(edits), tree.n_tokens, tree.n_chars, tree.reencoded)
                rows.append((doc_id, tree.whole, tree.chars, tree.counts, *own) if trees_too else (doc_id, *own))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = f"{TREES}, {COUNTS}" if trees_too else f"doc_id long, {COUNTS}"
    names = [c.split()[0] for c in schema.split(", ")]
    own = only(trees, "doc_id", "text", "chars", "counts", "edits")
    touched = F.coalesce(F.size("edits") > 0, F.lit(False))
    n, root = F.lit(0).cast("long"), F.get("counts", F.lit(1)).cast("long")
    values = {"n_tokens": root, "n_edits": n, "n_tokens_after": root, "n_chars_after": F.get("chars", F.lit(1)).cast("long"), "n_reencoded": n}
    rest = own.where(~touched).select(*[values.get(c, F.col(c)).alias(c) for c in names])
    return own.where(touched).mapInPandas(run, schema).unionByName(rest)


def edit_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and COUNTS for rows with doc_id, text and ``edits`` (EDITS; null: none), by way of stored trees.

    Null text is empty. Repeated rows are counted each for itself. Equal edits of one place apply in their order. A
    very long text without any safe cut (one word) is one segment. An empty table gives an empty result, columns of
    other names are not looked at.
    """
    return apply_edits(build(docs, tokenizer, "edits"), tokenizer, False)


def stated_edits(doc_id: Column, n_chars: Column) -> Column:
    """The edits of the registered query: a replacement near the front, a deletion, an insertion and an appended
    end, at places that a hash of doc_id picks from the whole text."""
    n = n_chars.cast("long")
    at = lambda k: F.pmod(F.xxhash64(doc_id, F.lit(k)), n + 1)
    rows = [(at(1), 7, "changed words"), (at(2), 40, ""), (at(3), 0, " put in here "), (n, 0, "\nThe end.")]
    return F.array(*[F.struct(a.cast("long").alias("at"), F.lit(d).cast("long").alias("n_deleted"), F.lit(s).alias("inserted")) for a, d, s in rows])


def token_count_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and COUNTS of every row: trees are built and stored, then read again for the stated edits, whose places
    come from the trees' own sums. Null text is empty; repeated rows, rows without doc_id and ties are rows of their
    own; an empty table gives an empty result."""
    trees = build(docs, tokenizer)
    edited = trees.withColumn("edits", stated_edits(F.col("doc_id"), F.get("chars", F.lit(1))))
    return apply_edits(edited, tokenizer, False)
