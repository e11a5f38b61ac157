"""Language identification by rank-order profiles of n-grams.

A language's profile is its most frequent n-grams (1 to 3 letters, words padded by blanks) in order; so is a
document's. The out-of-place distance adds up how far each n-gram of the document stands from its place in the
profile, with the profile's length for those it lacks. The least distance wins.

Profiles are learned from a bounded sample of labelled rows (``SAMPLE`` documents of each language, drawn by a hash
of doc_id); every document is judged by its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import crc_of_id, mapped, only

#: n-grams of a profile.
RANKS = 300
#: Documents that a profile is learned from, in expectation.
SAMPLE = 1500
FOLDS = 4
#: Profiles are RANKS rows for each language and go to every task; a table of more lang values is refused.
MOST_LANGUAGES = 2000
NONE = "und"


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, packed in 63 bits, and their counts. Case and all but letters fall away."""
    if not isinstance(text, str):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = letter_table()[np.minimum(code, 0x10FFFF)]
    code = np.concatenate(([0], np.where(letters, code, 0), [0, 0])).astype(np.int64)
    # Runs of what are no letters shrink to one blank (0), which pads the words.
    code = code[(code != 0) | np.concatenate(([True], code[:-1] != 0))]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = code[:-2], code[1:-1], code[2:]
    one = code[code != 0]
    two = (code[:-1] << 21 | code[1:]) | 1 << 42
    three = (a << 42 | b << 21 | c)[b != 0]
    # 21 bits for each letter; pairs look like triples that begin with code point 1, which is no letter.
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ranked(keys: np.ndarray, counts: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent keys in order; ties by key."""
    return keys[np.lexsort((keys, -counts))[:ranks]]


class Profiles:
    """Rank of each profile's n-grams by language, and the distance of a document to each."""

    def __init__(self, ordered: dict[str, list[int]], ranks: int = RANKS):
        self.ranks, self.langs = ranks, sorted(ordered)
        self.sorted, self.places = {}, {}
        for lang in self.langs:
            keys = np.array(ordered[lang], np.int64)
            by = np.argsort(keys)
            self.sorted[lang], self.places[lang] = keys[by], by

    def judge(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 minus the share of the greatest distance possible. Ties go to the first name."""
        keys, counts = grams(text)
        if not len(keys) or not self.langs:
            return NONE, 0.0
        doc = ranked(keys, counts, self.ranks)
        best = min((self.distance(lang, doc), lang) for lang in self.langs)
        return best[1], 1 - best[0] / (self.ranks * len(doc))

    def distance(self, lang: str, doc: np.ndarray) -> int:
        keys = self.sorted[lang]
        at = np.minimum(np.searchsorted(keys, doc), len(keys) - 1)
        apart = np.abs(self.places[lang][at] - np.arange(len(doc)))
        return int(np.where(keys[at] == doc, np.minimum(apart, self.ranks), self.ranks).sum())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of_id(doc_id) % FOLDS == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE, ranks: int = RANKS) -> Profiles:
    """Profiles from rows with lang and doc_id that are not held out."""
    rows = only(docs, "doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    totals = rows.groupBy("lang").agg(F.count("*").alias("n"))
    if totals.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang: profiles go to every task")
    share = ((1 << 30) * F.least(F.lit(1.0), F.lit(sample) / F.col("n"))).cast("long")
    drawn = rows.join(totals, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < share)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                parts = [grams(t) for t in texts]
                keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                yield pd.DataFrame({"lang": lang, "gram": keys, "n": np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)})

    counts = drawn.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= ranks)
    ordered: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():  # ranks rows for each language
        ordered.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ordered, ranks)


def identified(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """All columns of ``docs`` (own ones of the same names replaced) with held_out, lang_pred and score.

    A null text or one without letters is "und" with score 0. Very long texts are read whole; equal distances go to
    the first name; repeated rows are rows of their own; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(profiles)
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "lang_pred", "score")])
    added = "lang_pred string, score double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [held.value.judge(t) for t in frame["text"]]
            yield frame.assign(lang_pred=[x[0] for x in found], score=[x[1] for x in found])

    return mapped(base, run, added).withColumn("held_out", held_out(F.col("doc_id")))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row. Cases as in ``identified``; without any labelled row to
    learn from every text is "und"; a null lang is not learned from, a null doc_id neither held out nor learned from."""
    return identified(only(docs, "doc_id", "text"), learn(docs)).select("doc_id", "held_out", "lang_pred", "score")
