"""Vector codes against a plain version of the same rules."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, `a.b` string, part int"


def plain(rows):
    """rows of (vec_id, vector, label); the vectors' integers are cut, assigned and averaged as stated."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // 4) * 4
    d = width // 4
    whole = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    cut = [[v[p * d : (p + 1) * d] for p in range(4)] for v in whole]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[cut[k][p] for k in order[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda part, book: min((far(part, e), j) for j, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            got = [best(c[p], books[p])[1] for c in cut]
            for j in range(len(books[p])):
                own = [c[p] for c, g in zip(cut, got, strict=True) if g == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    final = [[best(c[p], books[p]) for p in range(4)] for c in cut]
    out = [(r[0], r[2], "".join(f"{j:02x}" for _, j in f), sum(e for e, _ in f)) for r, f in zip(kept, final, strict=True)]
    by = {}
    for _, label, _, e in out:
        by[label] = by.get(label, 0) + e
    return sorted((str(i), code, e, by[label], sha) for i, label, code, e in out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "old", "dot", 1) for r in rows], SCHEMA)


def report(spark, rows):
    got = V.vector_code_report(vectors(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((str(r[0]), *list(r)[1:]) for r in got.collect())


def test_many_vectors_with_odd_ones(spark):
    r = random.Random(2)
    rows = [(k, [r.gauss(0, 0.2) for _ in range(16)], r.choice([None, 1, 1, 1, 2, k])) for k in range(420)]
    rows += [(3, rows[3][1], 2), (7, [0.5] * 16, None), (None, [0.1] * 16, 5), (None, [0.1] * 16, 5)]
    rows += [(500, None, 1), (501, [0.1, None] * 8, 1), (502, [float("nan")] * 16, 1), (503, [float("-inf")] + [0.0] * 15, 1)]
    assert report(spark, rows) == plain(rows)


def test_few_rows_other_lengths_and_ties(spark):
    rows = [(5, [1.0, -1.0, 0.25, 2.0, -0.0001], 1), (2, [1.0, -1.0], 1), (2, [], None), (9, [0.0] * 8, None)]
    assert report(spark, rows) == plain(rows)
    assert report(spark, [(1, [0.5] * 8, 1)] * 300) == plain([(1, [0.5] * 8, 1)] * 300)
    assert report(spark, [(1, [], 1), (2, [], 1)]) == plain([(1, [], 1), (2, [], 1)])


def test_nothing_to_code(spark):
    assert report(spark, []) == report(spark, [(1, None, 1), (2, [None], 2)]) == []


def test_components_without_exact_distances_are_refused(spark):
    with pytest.raises(Exception, match="exact distances"):
        report(spark, [(1, [1e30, 0.0, 0.0, 0.0], 1)])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 300), st.sampled_from([1, 3, 400, 100_000_000]), st.integers(0, 10**6))
def test_no_nearest_entry_is_lost(d, n, spread, seed):
    rng = np.random.default_rng(seed)
    book = rng.integers(-spread, spread + 1, (n, d))
    rows = np.r_[rng.integers(-spread, spread + 1, (40, d)), book[:20]]
    code, error, asked = V.Codebook(book).nearest(rows)
    far = ((rows[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
    assert code.tolist() == far.argmin(1).tolist() and error.tolist() == far.min(1).tolist() and asked <= far.size


def test_bounds_filter_from_coarse_to_fine():
    rng = np.random.default_rng(7)
    book = np.cumsum(rng.integers(-60, 61, (256, 32)), axis=1)
    rows = book[rng.integers(0, 256, 200)] + rng.integers(-3, 4, (200, 32))
    _, _, asked = V.Codebook(book).nearest(rows)
    assert asked < 3 * len(rows)
    coarse = V.Codebook(book)
    coarse.levels, coarse.marks = coarse.levels[:1], coarse.marks[:1]
    assert coarse.nearest(rows)[2] > asked


def test_features_of_all_levels_bound_distances():
    rng = np.random.default_rng(8)
    a, b = rng.integers(-900, 900, (50, 13)), rng.integers(-900, 900, (50, 13))
    true = ((a - b) ** 2).sum(1)
    last = np.zeros(50)
    for cuts in V.Codebook(b).levels:
        bound = ((V.Codebook.features(a, cuts) - V.Codebook.features(b, cuts)) ** 2).sum(1)
        assert (bound <= true * (1 + 1e-9)).all()
        last = bound
    assert (last > 0).all()


def test_codes_stand_for_vectors(spark):
    rows = [(k, [float(k % 5), 0.5, -1.0, 2.0], 1) for k in range(12)]
    books, width = V.trained(vectors(spark, rows))
    codes = V.encode(vectors(spark, rows), books, width, "embedding", "vec_id")
    got = V.decode(codes, books).collect()
    assert {r["vec_id"]: r["approximation"] for r in got} == {k: v for k, v, _ in rows} and all(r["error"] == 0 for r in got)


def test_integers_of_sliced_batches():
    whole = pa.array([[1.0], None, [0.5, -0.0001], [None], []], pa.list_(pa.float32()))
    good, rows = V.integers(whole.slice(1), 4)
    assert good.tolist() == [False, True, False, True] and rows.tolist() == [[512, -1, 0, 0], [0, 0, 0, 0]]
