"""Phrase mining against a plain version of the same rules."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gristmill.llm import collocations as C
from gristmill.llm.common import looked_up
from tests.llm.fixtures import SCHEMA, frame, lower_ascii, odd_texts


def plain(rows, least=30, top=2000):
    """rows of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower_ascii(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    many = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    over = defaultdict(int)
    for (lang, *w), a in many.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                over[lang, *w[i : i + k]] = max(over[lang, *w[i : i + k]], a)
    found = defaultdict(list)
    for (lang, *w), a in many.items():
        cuts = [(f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min((2000000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))  # noqa: E741
        if 100 * over[lang, *w] < 80 * a:
            found[lang].append((-score, -a, " ".join(w).encode(), l, r))
    out = []
    for lang, own in found.items():
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(own)[:top])]
    return sorted(out)


def corpus(seed, n, words=30):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["É", "日本", "New", "York"]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(r.randint(0, 60)):
            some = r.choice([["New", "york"], ["in", "the", "city", "of"], ["in", "the"], [r.choice(vocabulary)], [r.choice(vocabulary)], ["a", "a", "a", "a", "a"]])
            text += " ".join(some) + r.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "\r\n"])
        rows.append((r.choice(["en", "en", "en", "de", None, ""]), text))
    return rows


def check(spark, rows, **kinds):
    docs = frame(spark, [t for _, t in rows], langs=[x for x, _ in rows])
    got = C.collocation_report(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    want = plain(rows)
    assert sorted(map(tuple, got.collect())) == want
    return want


@pytest.mark.parametrize("bits", [C.FEWEST_BITS, 6])
def test_phrases_of_a_corpus(spark, monkeypatch, bits):
    """With few buckets almost all are marked; the result is the same."""
    monkeypatch.setattr(C, "FEWEST_BITS", bits)
    monkeypatch.setattr(C, "MOST_BITS", bits)
    monkeypatch.setattr(C, "ROWS_OUT", 50)
    monkeypatch.setattr(C, "HELD", 90)
    monkeypatch.setattr(C, "TEXT", 700)
    rows = corpus(1, 400) + [("en", t) for t in odd_texts()] + [("en", "same long line of the whole corpus here")] * 200
    want = check(spark, rows)
    assert len({r[0] for r in want}) > 2 and any(len(r[2].split()) == 4 for r in want)


def test_repeats_overlap_and_edges(spark):
    check(spark, [("en", "a a a a a a a a")] * 12 + [(None, "x y. x y, x y")] * 10 + [("en", "b c")] * 29 + [("en", None), ("en", "")])
    check(spark, [("en", " \t\n.;")])
    assert C.collocation_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pruning_leaves_out_most_phrases(spark):
    rows = [("en", " ".join(f"u{random.Random(k).randrange(10**6)}" for _ in range(3)) + f" new york {k} x{k} y{k}") for k in range(400)]
    docs = frame(spark, [t for _, t in rows], langs=["en"] * len(rows)).select("lang", "text")
    first = C.phrase_rows(docs, 1, 16, 30, 4, None, None).cache()
    words = first.where("phrase is not null").groupBy("hash").agg(F.sum("n").alias("a")).where("a >= 30")
    second = C.phrase_rows(docs, 2, 16, 30, 4, C.bitmap(words.select("hash"), 16), C.hot_buckets(first, 16, 30))
    assert {r["phrase"] for r in second.where("phrase is not null").collect()} == {"new york"}


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**15, 10**15 + 7, 3 * 10**15), (2**62, 2**62, 2**63 - 1), (30, 30, 30), (31, 77, 1000), (9007199254740993, 9007199254740994, 9007199254740995)]
    got = spark.createDataFrame(cases, "a long, l long, r long").select(C.dice(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in got] == [2000000 * a // (l + r) for a, l, r in cases]


def test_lookups_with_hot_keys(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 2 else f"k{k % 7}") for k in range(3000)], "id long, key string")
    side = spark.createDataFrame([("hot", 1), ("k0", 2), ("k2", 3), ("unused", 4)], "key string, v int")
    got = looked_up(rows, side, ["key"], 3).collect()
    known = {"hot": 1, "k0": 2, "k2": 3}
    assert sorted((r["id"], r["v"]) for r in got) == sorted((k, known[s]) for k, s in ((k, "hot" if k % 2 else f"k{k % 7}") for k in range(3000)) if s in known)
