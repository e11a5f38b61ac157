"""Line dedup and SimHash near-dedup against plain versions."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from gristmill.llm import simhash
from gristmill.llm.common import new_path
from gristmill.llm.components import components
from gristmill.llm.line_dedup import CuckooFilter, LineIndex, dedup_lines, filled, line_dedup_report
from tests.llm.fixtures import frame, lower_ascii, odd_texts, prose, split_words


def plain_line_dedup(docs):
    held, key = defaultdict(set), lambda line: lower_ascii(line.strip(" \t\n\x0b\x0c\r"))
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                held[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        gone = [i is not None and len(held.get(key(x), ())) > 1 and i != min(held[key(x)]) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *map(str, r)))


def test_line_dedup_equals_plain_version(spark):
    texts = odd_texts()
    got = line_dedup_report(frame(spark, texts)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert order(map(tuple, got)) == order(plain_line_dedup(list(enumerate(texts))))


def test_line_dedup_with_repeated_rows_and_null_ids(spark):
    texts = ["a line of some length\nb", "a line of some length\nb", "A LINE of some length \nc", "a line of some length\nd"]
    ids = [5, 5, 7, None]
    got = line_dedup_report(frame(spark, texts, ids)).collect()
    assert order(map(tuple, got)) == order(plain_line_dedup(list(zip(ids, texts, strict=True))))


def test_rows_of_one_id_with_different_texts_lose_only_shared_lines(spark):
    ids = [1, 5, 5, 9]
    texts = [
        "shared line of text\nfirst of its own", "keep this one here aa\nanother private line\nshared line of text",
        "shared line of text\nprivate zeta line bb\nthe third private line", "another private line\nfirst of its own",
    ]
    got = line_dedup_report(frame(spark, texts, ids)).collect()
    assert order(map(tuple, got)) == order(plain_line_dedup(list(zip(ids, texts, strict=True))))


def test_a_line_in_every_document_is_dealt_out_over_tasks(spark, monkeypatch):
    monkeypatch.setattr("gristmill.llm.line_dedup.PART_LINES", 7)
    texts = [f"the line that all have\nand {'one' if k % 3 else 'two'} of some more words\n{prose(k, 4)}" for k in range(90)]
    got = line_dedup_report(frame(spark, texts)).collect()
    assert order(map(tuple, got)) == order(plain_line_dedup(list(enumerate(texts))))


def test_line_dedup_keeps_columns_and_takes_empty_tables(spark):
    docs = frame(spark, odd_texts())
    out = dedup_lines(docs)
    assert set(docs.columns) <= set(out.columns)
    assert out.schema["n_lines"].dataType.simpleString() == "bigint"
    assert dedup_lines(docs.limit(0)).count() == 0
    assert out.where("text is null").count() == 1


def test_incremental_changes_equal_a_fresh_index(spark):
    r = random.Random(4)
    lines = [f"line number {k} of the pool" for k in range(30)]
    texts = ["\n".join(r.sample(lines, 6)) for _ in range(40)]
    docs = frame(spark, texts).select("doc_id", "text")
    path = f"{new_path(spark, 'index')}"
    index = LineIndex(spark, path, shards=3)
    index.insert(docs.where("doc_id < 20")).insert(docs.where("doc_id between 10 and 39")).delete(docs.where("doc_id % 3 = 0"))
    left = docs.where("doc_id % 3 != 0")
    assert same(spark, index, left) and same(spark, LineIndex(spark, path), left)
    again = LineIndex(spark, path).insert(docs.where("doc_id = 3")).delete(docs.where("doc_id < 10"))
    left = docs.where("doc_id >= 10 and doc_id % 3 != 0")
    assert same(spark, again, left) and len(LineIndex(spark, path).done) == 5
    assert again.delete(left).refs().where("n_docs > 0").count() == 0


def same(spark, index, left):
    """Counts, keepers and results equal those of a fresh index over the documents that are left."""
    fresh = LineIndex(spark, shards=2).insert(left)
    pick = lambda i: order(map(tuple, i.refs().select("h", "g", "n_docs", "keeper").where("n_docs > 0").collect()))
    show = lambda i: order(map(tuple, i.apply(left).select("doc_id", "text").collect()))
    return pick(index) == pick(fresh) and show(index) == show(fresh)


def test_changed_texts_merged_generations_and_broken_changes(spark, monkeypatch):
    monkeypatch.setattr("gristmill.llm.line_dedup.MERGE_AFTER", 2)
    monkeypatch.setattr("gristmill.llm.line_dedup.SHARD_KEYS", 3)
    path, texts = new_path(spark, "index"), {k: f"all of them have this\nof {k % 4} there are some\nown words of {k}" for k in range(16)}
    table = lambda: spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    LineIndex(spark, path).insert(table())
    for k in (0, 5, 6):
        texts[k] = f"of {k % 3} there are some\nnew words of {k}"
        LineIndex(spark, path).update(table().where(f"doc_id = {k}"))
    table().withColumnRenamed("text", "h").write.parquet(f"{path}/refs/000099-broken")
    index = LineIndex(spark, path)
    assert index.shards > 1 and len(index._live()) < len(index.done)
    assert same(spark, index, table())


def test_cuckoo_filter_holds_what_it_was_given_and_forgets_what_was_deleted():
    h = np.random.default_rng(0).integers(-(2**63), 2**63, 5000)
    f = filled(h)
    assert f.contains(h).all()
    assert f.contains(np.random.default_rng(1).integers(-(2**63), 2**63, 5000)).mean() < 0.01
    f.delete(h[:2500])
    g = CuckooFilter.load(f.buckets, f.dump())
    assert g.contains(h[2500:]).all()
    assert g.contains(h[:2500]).mean() < 0.01
    assert not CuckooFilter(1).insert(h[:50])


def plain_fingerprint(t):
    w = split_words(t, "[^\x20\x09-\x0d]+")
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    """Smallest doc_id reachable over links, for {doc_id: fingerprint}."""
    ids, seen = sorted(fps), {}
    for i in ids:
        if i not in seen:
            seen[i], todo = i, [i]
            while todo:
                x = todo.pop()
                for j in ids:
                    if j not in seen and (fps[x] ^ fps[j]).bit_count() <= 2:
                        seen[j] = i
                        todo.append(j)
    return seen


def test_simhash_report_equals_plain_version(spark):
    texts = odd_texts() + [prose(k % 7, 60) + f" end{k}" for k in range(40)]
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    groups = plain_groups(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_report(frame(spark, texts)).collect()}
    assert got == {i: (f"{fps[i]:016x}", groups[i]) for i in fps}
    assert simhash.simhash_report(frame(spark, [], [])).count() == 0


@pytest.mark.parametrize("group", [1, 48])
def test_links_reach_the_same_groups_however_blocks_are_split(spark, group):
    r = random.Random(9)
    fps = [r.getrandbits(64) for _ in range(30)]
    for _ in range(200):
        fps.append(r.choice(fps) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (r.random() < 0.3) * (1 << r.randrange(64)))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), group)
    pairs = links.collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in pairs)
    root = dict(map(tuple, components(links).collect()))
    parts = defaultdict(set)
    for f, s in zip(fps, signed, strict=True):
        parts[root.get(s, s)].add(f)
    want = defaultdict(set)
    for k, v in plain_groups(dict(enumerate(fps))).items():
        want[v].add(fps[k])
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


def test_links_in_groups_far_above_the_size_that_is_split(spark):
    """3 000 fingerprints that all agree on two blocks of bits: pairs equal brute force, and pivots prune nearly all
    pairs of unsplit groups before they are verified."""
    r, base = np.random.default_rng(2), int(np.random.default_rng(3).integers(0, 2**63))
    fps = {base}
    while len(fps) < 3000:
        x = r.choice([base, *list(fps)[:50]])
        for b in r.integers(20, 42, 1 + len(fps) % 5):
            x = int(x) ^ (1 << int(b))
        fps.add(x)
    a = np.array(sorted(fps), np.int64)
    apart = np.bitwise_count(a[:, None] ^ a[None, :])
    want = {(int(a[i]), int(a[j])) for i, j in np.argwhere((apart <= 2) & (a[:, None] < a[None, :]))}
    frame_ = spark.createDataFrame([(int(x),) for x in a], "fp long")
    assert set(map(tuple, simhash.links(frame_).collect())) == want
    table = np.array([x["d"] for x in simhash.pivot_table(frame_).orderBy("fp").collect()], int)
    survive = (np.abs(table[:, None, :] - table[None, :, :]) <= 2).all(2)
    assert survive[apart <= 2].all() and survive[apart > 8].mean() < 0.01


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 199), (199, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 130)} | {200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark):
    texts, ids = odd_texts(), list(range(len(odd_texts())))
    docs = frame(spark, [*texts, texts[5], "lost"], [*ids, 5, None])
    out = simhash.distinct_documents(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(plain_similar(texts).values()))
    assert kept.count(None) == 1


@pytest.mark.parametrize("order", [(0, 1, 2), (0, 2, 1), (2, 1, 0)])
def test_an_id_of_different_texts_loses_only_the_near_copy(spark, order):
    a, b = prose(41, 80), prose(42, 80)
    rows = [(1, a), (5, a + " end"), (5, b)]
    rows = [rows[k] for k in order] + [(7, b), (5, b), (9, None), (9, "")]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows]).coalesce(1)
    assert sorted((r["doc_id"], r["text"] or "") for r in simhash.distinct_documents(docs).collect()) == [(1, a), (5, b), (9, "")]


def test_a_large_group_of_edited_copies(spark, monkeypatch):
    """Copies of one text that is not there itself: many are similar to some only, many to none."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    r, base = random.Random(12), prose(77, 150).split()
    texts = []
    for k in range(150):
        t = list(base)
        for _ in range(1 + k % 9):
            t[r.randrange(len(t))] = f"new{r.random()}"
        texts.append(" ".join(t))
    want = plain_similar(texts)
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(frame(spark, texts)).collect()}
    assert got == want and 2 < len(set(want.values())) < 150


def test_sketches_agree_as_shingles_do():
    r, agreed = np.random.default_rng(3), []
    for _ in range(200):
        x = np.unique(r.integers(0, 2**64, 270, np.uint64))
        p, q = (np.frombuffer(simhash.sketch(simhash.least_hashes(k)), np.uint8) for k in (x[:243], x[27:]))  # 216 of 270
        agreed.append((p == q).sum())
    assert min(agreed) >= simhash.least_agreement(0.8) and abs(np.mean(agreed) / 125 - 0.8) < 0.02


def plain_similar(texts):
    """Smallest number reachable over fingerprints within 2 bits or 0.8 of the five-word shingles in common."""
    def shingles(t):
        w = split_words(t, "[^\x20\x09-\x0d]+")
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    fps, sets = [plain_fingerprint(t) for t in texts], [shingles(t) for t in texts]
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0
    seen = {}
    for i in range(len(texts)):
        if i not in seen:
            seen[i], todo = i, [i]
            while todo:
                x = todo.pop()
                for j in range(len(texts)):
                    if j not in seen and near(x, j):
                        seen[j] = i
                        todo.append(j)
    return seen


def test_similar_documents_are_found_by_texts(spark):
    r, texts = random.Random(6), []
    for k in range(12):
        base = prose(900 + k, 300).split()
        for edits in (0, 2, 4, 6):
            t = list(base)
            for _ in range(edits):
                t[r.randrange(len(t))] = f"new{r.random()}"
            texts.append(" ".join(t))
    want = plain_similar(texts)
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(frame(spark, texts)).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)
    assert all(got[k] // 4 == k // 4 for k in got)
    assert simhash.similar_groups(frame(spark, [])).count() == 0


def test_similar_texts_meet_in_a_key_whatever_the_size():
    """The chance that two texts of exactly the similarity share no key, over 400 pairs of random sets."""
    r, met = np.random.default_rng(0), 0
    for _ in range(400):
        x = np.unique(r.integers(0, 2**64, 270, np.uint64))
        assert len(x) == 270
        met += bool(set(simhash.band_keys(x[:243]).tolist()) & set(simhash.band_keys(x[27:]).tolist()))  # 216 of 270
    assert met == 400


@pytest.mark.parametrize("groups", [8, 40])
def test_all_similar_documents_are_found_whatever_the_size(spark, groups):
    r, texts = random.Random(groups), []
    shared = prose(5, 70)  # a hot source: most of its documents begin alike
    for k in range(groups):
        base = (shared + " " if k % 2 else "") + prose(3000 + k, r.choice([12, 60, 160]))
        for edits in (0, 1, 2, 3, 5):
            t = base.split()
            for _ in range(edits * len(t) // 160 + (edits > 0)):
                t[r.randrange(len(t))] = f"new{r.random()}"
            texts.append(" ".join(t))
    want = plain_similar(texts)
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(frame(spark, texts)).collect()}
    assert got == want
