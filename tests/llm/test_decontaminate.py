import glob
import hashlib
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

from gristmill.llm import decontaminate
from tests.llm.fixtures import WORDS, frame, odd_texts, prose, split_words

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def plain(docs, items, window=10):
    windows, out = defaultdict(set), {}
    for i, t in items:
        w = split_words(t, WORD)
        for k in range(max(1, len(w) - window + 1)) if w and i is not None else ():
            windows[tuple(w[k : k + window])].add(str(i))
    for d, t in docs:
        w, hit, own = split_words(t, WORD), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    own |= windows[tuple(w[p : p + n])]
        out[d] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
    return out


def cases():
    long = prose(2, 6000).split()
    items = [(1, " ".join(long[100:160])), (2, " ".join(long[150:159])), (3, None), (4, ""), (5, "Zzz"), (None, "beta"), (6, "É日 x-Y"), (7, " ".join(long[100:160])), (10, prose(5, 40))]
    texts = [*odd_texts(), prose(5, 40) + " tail", "head " + " ".join(prose(5, 40).split()[3:20]) + " zzz", "é日 x É日 x y", " ".join(WORDS), "ZZZ zzz"]
    return texts, items


def test_report_equals_plain_version(spark):
    texts, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.decontamination_report(frame(spark, texts), table).collect()}
    assert got == plain(list(enumerate(texts)), items)


def test_blocks_of_items_give_the_same(spark):
    texts, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    one = decontaminate.judged(docs, table).select(*names).collect()
    many = decontaminate.judged(docs, table, block_bytes=200).select(*names).collect()
    assert sorted(one) == sorted(many)


def test_empty_tables_and_columns(spark):
    docs, none = frame(spark, odd_texts()), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judged(docs, none).where("contaminated").count() == 0
    assert decontaminate.judged(docs.limit(0), none).count() == 0
    out = decontaminate.decontaminated(docs, none)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_longest_matches_have_their_places(spark):
    words = prose(8, 80).split()
    docs = frame(spark, ["x y z " + " ".join(words[10:45]) + " w", " ".join(words)])
    items = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.matches(docs, items).collect()))
    assert got == [(0, "9", 3, 10, 26, 35), (1, "9", 0, 0, 71, 80)]


def plain_matches(docs, items, window=10):
    """Runs of at least a window on each diagonal, by looking at every pair of places."""
    out = []
    for d, t in docs:
        for i, u in items:
            a, b = split_words(t, WORD), split_words(u, WORD)
            n = min(window, len(b))
            for x in range(len(a)) if b else ():
                for y in range(len(b)):
                    if a[x] == b[y] and not (x and y and a[x - 1] == b[y - 1]):
                        k = 0
                        while x + k < len(a) and y + k < len(b) and a[x + k] == b[y + k]:
                            k += 1
                        if k >= n:
                            out.append((d, str(i), x, y, k - n + 1, k))
    return sorted(out)


def test_matches_equal_all_common_runs(spark):
    r = random.Random(3)
    texts = ["", None]
    for k in range(40):
        texts.append(" ".join(r.choice("abc") for _ in range(r.randint(1, 60))))
    w = [f"w{k}" for k in range(11)]
    texts.append(" ".join(w))
    items = [(k, " ".join(r.choice("abc") for _ in range(r.randint(1, 24)))) for k in range(60)]
    items.append((99, " ".join([*w[:10], "q1", "q2", *w[1:]])))
    table = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1 << 20, 300):
        got = sorted(map(tuple, decontaminate.matches(frame(spark, texts), table, window=5, block_bytes=block_bytes).collect()))
        assert got == plain_matches(list(enumerate(texts)), items, 5)


def test_suffix_arrays_are_sorted_to_the_end():
    r = np.random.default_rng(1)
    for n, k in ((0, 1), (1, 1), (50, 1), (300, 2), (2000, 5)):
        ids = r.integers(0, k, n)
        assert decontaminate.suffix_array(ids).tolist() == sorted(range(n), key=lambda p: ids[p:].tolist())


def test_columns_of_any_names_keep_their_values(spark):
    item = prose(5, 40)
    docs = spark.createDataFrame([(1, "some words", "u1", "x"), (2, item, "u2", "y"), (2, "other words", "u3", "z"), (None, item, "u4", "w")], "doc_id long, text string, n_hit string, `a.b` string")
    out = decontaminate.decontaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "some words", "u1", "x"), (2, "other words", "u3", "z")]


def test_a_stem_that_all_items_share_is_one_list(spark):
    """1 500 items that begin alike against 600 documents with that beginning: marks are carried, not names."""
    stem = prose(50, 12)
    items = [(f"i{k}", f"{stem} item{k} ends here") for k in range(1500)] + [("other", prose(51, 14)), ("short", "one two")]
    texts = [f"{prose(60 + k, 5)} {stem} {prose(70 + k, 5)}" for k in range(600)] + [prose(51, 14), f"{stem} and {prose(51, 14)}", "one two three", "", None]
    block = decontaminate.ItemBlock(items)
    assert max(map(len, block.lists)) == 1500 and len(block.lists) < 1510
    docs = frame(spark, texts)
    got = {r["doc_id"]: (r["n_items"], r["items_sha256"]) for r in decontaminate.decontamination_report(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    sha = lambda names: hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    all_ = [f"i{k}" for k in range(1500)]
    assert all(got[k] == (1500, sha(all_)) for k in range(600))
    assert got[600] == (1, sha(["other"])) and got[601] == (1501, sha([*all_, "other"])) and got[602] == (1, sha(["short"]))
    assert got[603] == got[604] == (0, sha([]))


def test_row_groups_of_the_index_are_bounded(spark, monkeypatch):
    """24 shards of one task, 17 MB in all: the writer and the readers hold some 8 MB of them at once."""
    monkeypatch.setattr(decontaminate, "SHARD_CHARACTERS", 1)
    r = random.Random(4)
    docs = frame(spark, [" ".join(str(r.randrange(10**6)) for _ in range(60_000)) for _ in range(24)]).coalesce(1)
    (path,) = glob.glob(f"{decontaminate.suffix_index(docs).stored_at.removeprefix('file:')}/*.parquet")
    groups = [pq.read_metadata(path).row_group(k) for k in range(pq.read_metadata(path).num_row_groups)]
    assert sum(g.num_rows for g in groups) == 24
    assert sum(g.total_byte_size for g in groups) > 15 << 20
    assert max(g.total_byte_size for g in groups) < 10 << 20


def test_windows_are_looked_for_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(decontaminate, "ASKED", 1000, raising=False)
    r = random.Random(6)
    words = [f"w{k}" for k in range(2000)]
    items = [(f"i{k}", " ".join(r.choices(words, k=40))) for k in range(3000)]
    texts = [" ".join(r.choices(words, k=300)) + (" " + items[k][1] if k % 2 else "") for k in range(40)]
    block, (shard, lengths) = decontaminate.ItemBlock(items), decontaminate.Shard.build(texts)
    tracemalloc.start()
    got = decontaminate.hits(shard, block, np.arange(40), np.zeros(40, np.int64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 << 20  # 93 000 windows of ten numbers are 7 MB
    names = dict(zip(block.marks, block.lists, strict=True))
    assert {d: {n for m in lists for n in names[m]} for d, _, _, lists in got} == {k: {f"i{k}"} for k in range(1, 40, 2)}
    assert all(spans[-1] == {"a": 300, "b": 340} for _, _, spans, _ in got)
