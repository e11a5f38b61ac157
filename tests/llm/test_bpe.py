"""BPE by speculation against the tokenizer itself and against plain merging."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gristmill.llm import bpe
from gristmill.llm.tokens import default_tokenizer
from tests.llm.fixtures import SCHEMA, frame, odd_texts, prose

MORE = ["<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext|", "aaaaaaaaaaaaaaaaaaaaaaa" * 40, " " * 700, "\n \n\t x", "don't we'LL I'd", "՘࢏", "é \U0001f389\U0001f389 \U000107bb"]


@pytest.fixture(scope="module")
def pair():
    return bpe.vocabulary(default_tokenizer()), Tokenizer.from_file(default_tokenizer())


def same(pair, text):
    own, public = pair
    ids = own.encode(text)
    assert ids == public.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == public.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(pair, text):
    same(pair, text)


@settings(max_examples=400, deadline=None)
@given(st.text("abcdeinrst'lv \n\t10éあ.!-AI　", max_size=80))
def test_texts_of_few_letters(pair, text):
    same(pair, text)


def test_pairs_that_are_compatible_are_those_that_merge_to_themselves(pair):
    own, _ = pair
    r, few = random.Random(3), [k for k in range(own.n) if 0 < len(own.bytes[k]) <= 4 and own.bytes[k].isalpha()]
    a, b = ([r.choice(few) for _ in range(4000)] for _ in range(2))
    told = own.compatible(bpe.np.array(a), bpe.np.array(b)).tolist()
    plain = [own.merged(own.bytes[x] + own.bytes[y]) == [x, y] for x, y in zip(a, b, strict=True)]
    assert told == plain and 100 < sum(told) < 3900


def test_merging_together_is_merging_one_by_one(pair):
    own, _ = pair
    r = random.Random(4)
    words = ["".join(r.choice("abehnorst") for _ in range(r.randint(1, 40))).encode() for _ in range(500)] + [b"a" * 256, b"ab" * 100]
    assert own.merged_together(words) == [own.merged(w) for w in words] and own.merged_together([]) == []


def test_only_failing_words_are_merged(pair, monkeypatch):
    own = bpe.Vocabulary(default_tokenizer())
    r = random.Random(5)
    words = [" the", " because", "a", *("".join(r.choice("aeinorsth") for _ in range(12)) for _ in range(100))]
    proposed, failing = own.speculate([w.encode() for w in words])
    asked = []
    monkeypatch.setattr(own, "merged_together", lambda some: asked.extend(some) or [[0]] * len(some))
    out = own.words_to_ids(words)
    assert asked == [words[k].encode() for k in failing.tolist()] and 0 < len(failing) < len(words)
    assert all(list(out[k]) == proposed[k] for k in range(len(words)) if k not in failing)


def test_settled_characters_are_cut_alike(pair):
    own, _ = pair
    for c in map(chr, (c for c in range(0x30000) if not 0xD800 <= c < 0xE000)):
        if bpe.SETTLED.fullmatch(c):
            text = f"a{c}1{c}! {c}"
            assert bpe.PATTERN.findall(text) == [text[a:b] for _, (a, b) in own.splitter.pre_tokenize_str(text)], hex(ord(c))


def test_pieces_of_long_texts(pair, monkeypatch):
    own, public = pair
    monkeypatch.setattr(bpe, "CHUNK", 7)
    texts = ["", prose(1, 60), "x" * 900, "one two՘ three four five six seven eight nine", "", *odd_texts()[9:13]]
    got = [[] for _ in texts]
    for k, ids in own.encoded(texts):
        got[k] += ids
    assert got == [public.encode(t, add_special_tokens=False).ids for t in texts]


def test_unknown_vocabularies_are_refused(tmp_path):
    bad = tmp_path / "bad.json"
    bad.write_text('{"model": {"type": "WordPiece", "vocab": {}}, "pre_tokenizer": {"type": "ByteLevel"}, "normalizer": null, "added_tokens": []}')
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(bad))


def test_report_and_round_trip(spark, pair):
    texts = odd_texts() + MORE
    own, public = pair
    docs = frame(spark, texts, ids=[None, 3, 3, *range(3, len(texts))])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [public.encode(t or "", add_special_tokens=False).ids for t in texts]
    want = sorted((len(i), sha(",".join(map(str, i))), sha(t or "")) for i, t in zip(ids, texts, strict=True))
    got = bpe.bpe_report(docs, default_tokenizer())
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r)[1:] for r in got.collect()) == want
    both = bpe.decode(bpe.encode(docs, default_tokenizer()), default_tokenizer())
    assert both.columns == [*docs.columns, "ids", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") and r["a.b"] == "dot" for r in both.collect())
    assert bpe.bpe_report(spark.createDataFrame([], SCHEMA), default_tokenizer()).count() == 0
