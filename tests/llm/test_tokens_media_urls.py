"""Token counts, packing, media and URL operators: exact round trips and plain versions."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gristmill.llm import media, packing, token_counts, url_filter
from gristmill.llm.tokens import Tokens, default_tokenizer
from tests.llm.fixtures import frame, odd_texts, prose


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def test_ids_equal_the_tokenizers_own(tokenizer):
    own, r = Tokens(default_tokenizer()), random.Random(0)
    parts = ["a", "B", " ", "  ", "\n", "'s", "é", " 12", "!", "\t", "<|endoftext|>", "\0", "　", "'"]
    for t in [*(x for x in odd_texts() if x), *("".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(2000))]:
        assert own.ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_equals_plain_pieces_and_has_no_gaps(spark, tokenizer):
    texts = [*odd_texts(), prose(11, 3000), prose(12, 900), prose(13, 10)]
    want = {}
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        edges = [0, len(ids)] if len(ids) <= 2048 else [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[i, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    rows = packing.pack(frame(spark, texts), default_tokenizer()).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    check_sequences(rows)
    assert packing.pack(frame(spark, []), default_tokenizer()).count() == 0


def check_sequences(rows, capacity=2048):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_repeated_and_null_ids_are_packed_each_for_itself(spark):
    rows = packing.pack(frame(spark, ["same text"] * 5, [1, 1, 1, None, 2]), default_tokenizer()).collect()
    assert len(rows) == 5 and check_sequences(rows) == 1


@pytest.mark.parametrize("seed", range(30))
def test_plans_place_everything_once(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 2048])
    want = defaultdict(int)
    for _ in range(r.randint(0, 50)):
        want[r.randint(1, capacity)] += r.randint(1, r.choice([3, 60]))
    plan = packing.Plan(dict(want), capacity)
    have = defaultdict(int)
    for gap, shapes in plan.open.items():
        for bins, shape in shapes:
            assert bins > 0 and sum(n * k for n, k in shape) == capacity - gap <= capacity
            assert sum(k for n, k in shape if 3 * n > capacity) <= 2
            for n, k in shape:
                have[n] += bins * k
    assert have == want
    # First fit decreasing is within 11/9 of the best; the plan is no worse.
    assert plan.bins() <= first_fit(want, capacity) + 1


def first_fit(histogram, capacity):
    gaps = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            for k, g in enumerate(gaps):
                if g >= n:
                    gaps[k] -= n
                    break
            else:
                gaps.append(capacity - n)
    return len(gaps)


def test_edits_give_the_counts_of_the_edited_text(spark):
    own, r = Tokens(default_tokenizer()), random.Random(2)
    for t in [*(x or "" for x in odd_texts()), *(prose(k, 200) for k in range(20))]:
        tree, now = token_counts.CountTree(t, own), t
        for _ in range(8):
            at, n = r.randint(0, len(now) + 3), r.choice([0, 0, 1, 3, 50, 600])
            put = r.choice(["", " ", "  ", "x", " yes ", "\n", "abc def ghi", "!", "'s"])
            tree.edit(at, n, put)
            a = min(at, len(now))
            now = now[:a] + put + now[a + n :]
            assert (tree.text(), tree.n_chars) == (now, len(now))
            assert tree.n_tokens == len(own.ids(now))
    long = token_counts.CountTree(prose(1, 5000), own)
    long.edit(9000, 5, "word")
    assert long.reencoded < 1500
    for joined in ("".join(f"line{k}\n" for k in range(4000)), "一二三四五六七，" * 3000):
        tree = token_counts.CountTree(joined, own)
        tree.edit(9000, 5, "字，" * 400)
        tree.edit(9000, 900, None)
        assert tree.n_tokens == len(own.ids(tree.text())) and tree.reencoded < 4500


def test_cuts_never_change_the_counts():
    own, r = Tokens(default_tokenizer()), random.Random(7)
    parts = ["a", "B", " ", "  ", "\n", "'s", "'", "é", " 12", "3", "!", ".", "\t", "<|endoftext|>", "<|", "\0", "\x1c", "\x85", "　", "日本", "。", "\u2028", "ß", "'ll", "-"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(2, 14)))
        for k in range(1, len(t)):
            if token_counts.safe(t[:k], t[k:], own.special):
                assert len(own.ids(t[:k])) + len(own.ids(t[k:])) == len(own.ids(t)), (t, k)


def test_stored_trees_encode_only_what_edits_touch(spark):
    own, path = Tokens(default_tokenizer()), default_tokenizer()
    texts = [prose(k, 1500) for k in range(6)]
    trees = token_counts.build(frame(spark, texts), path)
    edits = spark.createDataFrame([(k, j, 900 * j + 31 * k, 12, "new words") for k in range(0, 6, 2) for j in range(3)], "doc_id long, seq int, at long, n_deleted long, inserted string")
    first = token_counts.apply_edits(token_counts.with_edits(trees, edits), path)
    again = {r["doc_id"]: r for r in token_counts.apply_edits(token_counts.with_edits(first.select("doc_id", "text", "chars", "counts"), edits), path).collect()}
    for k, t in enumerate(texts):
        for _ in range(2):
            for j in range(3) if k % 2 == 0 else ():
                at = 900 * j + 31 * k
                t = t[:at] + "new words" + t[at + 12 :]
        assert again[k]["text"] == t and again[k]["n_tokens_after"] == len(own.ids(t)) and again[k]["n_chars_after"] == len(t)
        assert again[k]["n_reencoded"] == 0 if k % 2 else 0 < again[k]["n_reencoded"] < 0.15 * len(t)


def test_token_count_report(spark):
    texts, own = odd_texts(), Tokens(default_tokenizer())
    got = {r["doc_id"]: r for r in token_counts.token_count_report(frame(spark, texts), default_tokenizer()).collect()}
    assert {k: r["n_tokens"] for k, r in got.items()} == {k: len(own.ids(t)) for k, t in enumerate(texts)}
    edits = spark.createDataFrame([(4, 2, 0, 3, "Six"), (4, 1, 0, 0, "Five "), (9, 1, 5, 5, None), (99, 1, 0, 0, "x")], "doc_id long, seq int, at long, n_deleted long, inserted string")
    out = {r["doc_id"]: r for r in token_counts.edit_counts(token_counts.with_edits(frame(spark, texts), edits), default_tokenizer()).collect()}
    assert out[4]["n_tokens_after"] == len(own.ids("Sixe Two words")) and out[4]["n_edits"] == 2
    assert out[9]["n_tokens_after"] == len(own.ids(texts[9][:5] + texts[9][10:]))
    assert out[0]["n_tokens"] == out[0]["n_tokens_after"] == 0 and len(out) == len(texts)


def test_media_round_trip(spark):
    texts = [*odd_texts(), "ÿ" * 9000]
    got = {r["doc_id"]: r for r in media.media_report(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + b"\0" * (-len(data) % 64 if data else 64)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-64:])
        file = media.write_avi(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
    assert media.media_report(frame(spark, [])).count() == 0


def test_frames_of_any_bytes_and_the_general_decoder():
    r = np.random.default_rng(0)
    for payload in (bytes(64), bytes(range(256)), r.integers(0, 256, 64 * 200, np.uint8).tobytes(), b"\xff\x00" * 32000):
        avi = media.Avi(media.write_avi(payload))
        seen = avi.samples()
        assert np.concatenate([s.ravel() for s in seen]).tobytes()[: avi.length] == payload
        blocks = media.pixels(avi.frames[0])[0]
        assert (blocks[::8, ::8] == seen[0]).all() and (blocks[7::8, 7::8] == seen[0]).all()


def java_jpeg(spark, rgb):
    """The image as a colour JPEG by the JVM's writer, and the JVM's own gray decoding of it."""
    jvm = spark._jvm
    high, wide, _ = rgb.shape
    image = jvm.java.awt.image.BufferedImage(wide, high, 1)
    for y in range(high):
        for x in range(wide):
            image.setRGB(x, y, int(rgb[y, x, 0]) << 16 | int(rgb[y, x, 1]) << 8 | int(rgb[y, x, 2]))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def as_avi(frames, name=b"00dc", rec=False):
    parts = b"".join(media._chunk(name, f) for f in frames)
    body = media._list(b"rec ", parts) if rec else parts
    return media._chunk(b"RIFF", b"AVI " + media._list(b"hdrl", media._chunk(b"avih", struct.pack("<10I16x", 40_000, *[0] * 9))) + media._list(b"movi", body))


def without_tables(jpeg):
    """The frame as motion-JPEG has it: no Huffman tables."""
    out, at = jpeg[:2], 2
    while jpeg[at + 1] != 0xDA:
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        if jpeg[at + 1] != 0xC4:
            out += jpeg[at : at + 2 + size]
        at += 2 + size
    return out + jpeg[at:]


def test_colour_frames_of_another_writer(spark):
    y, x = np.mgrid[0:37, 0:53]
    rgb = np.stack([4 * x, 5 * y, 255 - 2 * x - y], 2).clip(0, 255).astype(np.uint8)
    jpeg = java_jpeg(spark, rgb)
    luma, blue, red = media.pixels(jpeg)
    want = rgb @ np.array([0.299, 0.587, 0.114])
    assert luma.shape == (37, 53) and np.abs(luma - want).mean() < 3
    cb = (128 + rgb @ np.array([-0.168736, -0.331264, 0.5]))[::2, ::2]
    assert blue.shape == red.shape == (19, 27) and np.abs(blue[:18, :26] - cb[:18, :26]).mean() < 5
    assert [p.tolist() for p in media.pixels(without_tables(jpeg))] == [p.tolist() for p in media.pixels(jpeg)]
    dark = java_jpeg(spark, np.zeros((37, 53, 3), np.uint8))
    bad = jpeg[: len(jpeg) // 2]
    table = spark.createDataFrame(
        [(1, bytearray(as_avi([jpeg] * 3 + [dark] * 3))), (2, bytearray(as_avi([jpeg, bad, jpeg, b"junk"], rec=True))), (3, bytearray(as_avi([dark] * 9)[:-300])), (4, bytearray(as_avi([b"junk"]))), (5, bytearray(b"RIFF\xff"))],
        "doc_id long, media binary",
    )
    got = [(r["doc_id"], r["first_frame"], r["frames"], r["damaged"]) for r in media.clip_rows(table).collect()]
    assert sorted(got)[:2] == [(1, 0, 3, 0), (1, 3, 3, 0)]
    assert [g for g in got if g[0] == 2] == [(2, 0, 4, 2)] and sum(g[3] for g in got if g[0] == 3) == 1
    assert [g for g in got if g[0] == 4] == [(4, 0, 1, 1)] and not [g for g in got if g[0] == 5]


def test_restart_markers(spark):
    """Two flat grayscale blocks with a marker between them: the second difference starts anew."""
    one = media.write_frame(np.array([[200, 90]], np.uint8))
    head, scan = one[: one.index(b"\xff\xda")], one[one.index(b"\xff\xda") : one.index(b"\xff\xda") + 10]
    body = [media.WORDS[[v - 128 + 255]].astype(">u2").tobytes().replace(b"\xff", b"\xff\x00") for v in (200, 90)]
    frame_ = head + media._segment(0xDD, b"\x00\x01") + scan + body[0] + b"\xff\xd0" + body[1] + b"\xff\xd9"
    assert media.read_frame(frame_).tolist() == [[200, 90]]


def plain_feature(text):
    """The report's feature from the payload's bytes alone."""
    data = (text or "").encode()
    data += b"\0" * (-len(data) % 64 if data else 64)
    rows = len(data) // 64
    count = -(-rows // 64)
    high = -(-rows // count)
    count = -(-rows // high)
    data = data.ljust(count * high * 64, b"\0")
    frames = [data[k * high * 64 : (k + 1) * high * 64] for k in range(count)]
    steps = [0.0]
    for f, g in zip(frames, frames[1:], strict=False):
        a, b = ([sum(x // 8 == k for x in y) / len(y) for k in range(32)] for y in (f, g))
        steps.append(sum(abs(p - q) for p, q in zip(a, b, strict=True)) / 2)
    starts = [0]
    for k in range(1, count):
        late = steps[max(starts[-1] + 1, k - 12) : k]
        mean = sum(late) / len(late) if late else 0
        usual = mean + 3 * (sum((x - mean) ** 2 for x in late) / len(late)) ** 0.5 if late else 0
        if steps[k] > max(0.25, usual):
            starts.append(k)
    shots = []
    for a, b in zip(starts, [*starts[1:], count], strict=True):
        shots.append(f"{a * 0.04:.2f}-{b * 0.04:.2f}:{sum(map(sum, frames[a:b])) / sum(map(len, frames[a:b])):.1f}")
    return f"frames={count};shots={len(shots)};" + ",".join(shots)


def test_features_equal_a_plain_version(spark):
    texts = [None, "", "abc", prose(1, 3000), "x" * 20_000 + "\n" * 9000 + prose(2, 900), "ÿ" * 9000]
    got = {r["doc_id"]: r["feature"] for r in media.media_report(frame(spark, texts)).collect()}
    assert got == {k: plain_feature(t) for k, t in enumerate(texts)}


def test_files_without_index_and_foreign_bytes(spark):
    data = media.write_avi(bytes(range(64)) * 300)
    k = data.index(b"idx1")
    assert [len(f) for f in media.Avi(data[:k]).frames] == [len(f) for f in media.Avi(data).frames]
    table = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"RIFFnothing")), (3, None)], "doc_id long, media binary")
    assert {r["doc_id"] for r in media.clip_rows(table).collect()} == {1}


def test_shots_are_cut_where_the_histogram_jumps():
    dark, light = np.full((8, 64), 20, np.uint8), np.full((8, 64), 200, np.uint8)
    frames = [dark] * 5 + [light] * 4 + [dark] * 3
    assert media.cuts(media.differences(frames)) == [0, 5, 9]
    assert media.cuts(media.differences([dark])) == [0]


def test_url_report_by_hand(spark):
    rows = [
        (1, "HTTP://Example.COM/en/7x?q#f", "example.com", "/en/7x", "example.com/en/7", "allow"),
        (2, "https://blog.Example.com/en/8", "blog.example.com", "/en/8", "com/en/", "block"),
        (3, "http://x.net/de/1", "x.net", "/de/1", "net/de/", "allow"),
        (4, "http://a.example.net/de/81", "a.example.net", "/de/81", "example.net/de/8", "block"),
        (5, "http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        (6, None, "", "", None, "allow"), (7, "no host here", "", "", None, "allow"), (8, "://", "", "", None, "allow"),
        (9, "http://t.org?utm_source=a", "t.org", "", None, "block"), (10, "http://t.org/#://x/", "t.org", "/", None, "block"),
        (11, "ftp://u.org#utm", "u.org", "", None, "allow"), (11, "http://w.org/es/2?utm_source=z", "w.org", "/es/2", "org/es/", "block"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "html", "clash", 1) for r in rows], "page_id long, url string, html string, host string, listed int")
    got = url_filter.url_report(pages).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(r[0], *r[2:]) for r in rows], key=str)
    assert url_filter.url_report(pages.limit(0)).count() == 0


@pytest.mark.parametrize("most", [url_filter.SHARD_WORDS, 30])
def test_cascade_is_exact_in_one_shard_and_in_several(spark, most, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARD_WORDS", most)
    keys = spark.range(3000).selectExpr("concat('k', id) as key", "id")
    listed = keys.where("id % 7 = 0 or id < 20").select("key")
    cascade = url_filter.Cascade(keys.select("key"), listed)
    assert (cascade.n_shards > 2) == (most == 30)
    out = cascade.contains(keys, "key", "in_list").where("in_list != (id % 7 = 0 or id < 20)")
    assert out.count() == 0
    none = url_filter.Cascade(keys.select("key"), listed.limit(0))
    assert none.contains(keys, "key", "in_list").where("in_list").count() == 0
    every = url_filter.Cascade(keys.select("key"), keys.select("key"))
    assert every.contains(keys, "key", "in_list").where("in_list").count() == 3000
