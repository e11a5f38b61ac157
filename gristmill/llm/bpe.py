"""Byte-level BPE by speculation: longest matches proposed, adjacent pairs checked, failing words merged exactly.

A sequence of tokens is what BPE makes of a word if each token is what BPE makes of its own bytes and each adjacent
pair is what BPE makes of the pair's bytes: until a merge crosses a border, both sides grow as they would alone. So
the longest token at each place is proposed (a trie walked at all bytes of a batch of distinct words at once), all
adjacent pairs are checked at once (their merges undone side by side, looking for one that would have come first across
the border), and only the words with a failing pair are merged by rank.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cached_property, lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import mapped, only

#: The pattern that cuts text into words before any merge, a fixed value of the vocabulary.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters that all Unicode versions in use class alike; texts with others are cut by the tokenizer's own splitter.
SETTLED = regex.compile(r"[\x00-\u0557\u0900-\u0963\u2000-\u206f\u20a0-\u20bf\u2100-\u2bff\u3000-\u9fff\uac00-\ud7a3\ufe00-\ufe0f\uff00-\uffef\U0001f300-\U0001f64f]*+")
#: Words that are handled at once; words that a worker remembers, and their greatest length in characters.
CHUNK, REMEMBERED, SHORT = 400_000, 400_000, 64
#: Words of at most TOGETHER bytes are merged together; the last FEW words of a step are walked one by one.
TOGETHER, FEW = 256, 32
#: The rank of a single byte, which no merge makes, and one that no merge has.
BYTE, NEVER = -1, 1 << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves, the others in order
    from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """``path``: a tokenizers JSON file with a BPE model, byte-level splitting and no normalizer. A file whose tokens
    have several merges, or merges that are listed before those of their parts, is refused, as are special tokens that
    take blanks or whole words around them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        ids = {bytes(letters[c] for c in t): k for t, k in model["vocab"].items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("special tokens with surroundings of their own are not supported")
        n = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.n, self.bytes = n, [b""] * n
        for b, k in ids.items():
            self.bytes[k] = b
        for t, k in self.special.items():
            self.bytes[k] = t.encode()
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self.left, self.right, self.rank = np.full(n, -1), np.full(n, -1), np.full(n, NEVER)
        self.rank[self.byte_id] = BYTE
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (ids[bytes(letters[c] for c in t)] for t in (merge.split(" ") if isinstance(merge, str) else merge))
            made = ids[self.bytes[a] + self.bytes[b]]
            if self.left[made] >= 0 or max(self.rank[a], self.rank[b]) >= rank:
                raise ValueError("merges are not in the order in which they build up the tokens")
            self.left[made], self.right[made], self.rank[made] = a, b, rank
            self.merges[a * n + b] = (rank, made)
        self.pair_keys = np.array(sorted(self.merges), np.int64)
        self.pair_ranks = np.array([self.merges[k][0] for k in self.pair_keys.tolist()], np.int64)
        self.pair_made = np.full(len(model["merges"]), -1, np.int64)
        for rank, made in self.merges.values():
            self.pair_made[rank] = made
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self._build_trie(self._whole())
        self.names = [str(k) for k in range(n)]
        self.known: dict[str, tuple] = {}
        self.cut_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def _whole(self) -> np.ndarray:
        """Tokens that BPE makes of their own bytes."""
        made = np.flatnonzero(self.left >= 0)
        good = self.rank == BYTE
        fits = self.compatible(self.left[made], self.right[made], self.rank[made])
        for k, ok in sorted(zip(made.tolist(), fits.tolist(), strict=True), key=lambda x: self.rank[x[0]]):
            good[k] = ok and good[self.left[k]] and good[self.right[k]]
        return good

    def _build_trie(self, usable: np.ndarray) -> None:
        edges, tokens = {}, [-1]
        for k in np.flatnonzero(usable).tolist():
            node = 0
            for b in self.bytes[k]:
                nxt = edges.get(node * 256 + b)
                if nxt is None:
                    nxt = edges[node * 256 + b] = len(tokens)
                    tokens.append(-1)
                node = nxt
            tokens[node] = k
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()], np.int64)
        self.node_token = np.array(tokens, np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
        """For each pair: no merge crosses its border while a and b are built (before rank ``end``). Both tokens are
        taken apart, the later merge first, to the last part of a and the first part of b that stand there at a time;
        a crossing merge must come before the part of a merges to its left, and not after the part of b merges to its
        right (of equal merges the left one comes first)."""
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_ends = np.full(len(a), NEVER) if end is None else end.astype(np.int64)
        y_ends = x_ends.copy()
        while len(at):
            r = self.pair_rank(x, y)
            bad = (r < x_ends) & (r <= y_ends) & (r < NEVER)
            out[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx != BYTE) | (ry != BYTE))
            at, x, y, x_ends, y_ends, rx, ry = (v[go] for v in (at, x, y, x_ends, y_ends, rx, ry))
            first = rx > ry
            x_ends, y_ends = np.where(first, rx, x_ends), np.where(first, y_ends, ry)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return out

    def longest(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest usable token that starts at each byte and does not pass that byte's end."""
        best = self.byte_id[data]
        at, node, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        while len(at):
            key = node * 256 + data[at + depth]
            found = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            hit = self.edge_keys[found] == key
            at, node = at[hit], self.edge_to[found[hit]]
            token = self.node_token[node]
            best[at[token >= 0]] = token[token >= 0]
            depth += 1
            more = at + depth < ends[at]
            at, node = at[more], node[more]
        return best

    def merged(self, word: bytes) -> list[int]:
        """BPE by rank: the pair of least rank first, of equal ones the leftmost. Takes some 60 bytes a byte."""
        part = array("q", self.byte_id[np.frombuffer(word, np.uint8)].tolist())
        n, size = self.n, len(word)
        after, before = array("q", range(1, size + 1)), array("q", range(-1, size - 1))
        queue = [(m[0] * size + k) for k in range(size - 1) if (m := self.merges.get(part[k] * n + part[k + 1]))]
        heapq.heapify(queue)
        while queue:
            rank, k = divmod(heapq.heappop(queue), size)
            nxt = after[k]
            m = self.merges.get(part[k] * n + part[nxt]) if part[k] >= 0 and nxt < size else None
            if not m or m[0] != rank:
                continue
            part[k], part[nxt], after[k] = m[1], -1, after[nxt]
            if after[k] < size:
                before[after[k]] = k
                if m := self.merges.get(part[k] * n + part[after[k]]):
                    heapq.heappush(queue, m[0] * size + k)
            if before[k] >= 0 and (m := self.merges.get(part[before[k]] * n + part[k])):
                heapq.heappush(queue, m[0] * size + before[k])
        return [p for p in part if p >= 0]

    def merged_together(self, words: list[bytes]) -> list[list[int]]:
        """The same for many short words at once: each round does one merge in every word that still has one."""
        size = np.array([len(w) for w in words], np.int64)
        part = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), size)
        rank = self._own_ranks(part, of, np.arange(len(part)))
        done_part, done_of = [], []
        while len(part):
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(part)]))
            over = least == NEVER
            done_part.append(part[over])
            done_of.append(of[over])
            part, of, rank, least = part[~over], of[~over], rank[~over], least[~over]
            at = np.flatnonzero(rank == least)
            at = at[np.r_[True, of[at[1:]] != of[at[:-1]]]] if len(at) else at
            part[at] = self.pair_made[rank[at]]
            keep = np.ones(len(part), bool)
            keep[at + 1] = False
            part, of, rank, at = part[keep], of[keep], rank[keep], at - np.arange(len(at))
            near = np.concatenate((at, at[at > 0] - 1))
            rank[near] = self._own_ranks(part, of, near)
        flat, of = np.concatenate([np.zeros(0, np.int64), *done_part]), np.concatenate([np.zeros(0, np.int64), *done_of])
        return self._rows(flat[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words)))

    def _own_ranks(self, part: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each place; NEVER at the end of a word."""
        nxt = np.minimum(at + 1, len(part) - 1)
        inside = (at < nxt) & (of[at] == of[nxt])
        out = np.full(len(at), NEVER)
        out[inside] = self.pair_rank(part[at[inside]], part[nxt[inside]])
        return out

    @staticmethod
    def _rows(flat: np.ndarray, counts: np.ndarray) -> list[list[int]]:
        values, ends = flat.tolist(), np.cumsum(counts).tolist()
        return [values[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []

    def speculate(self, words: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
        """The proposal for each word, and the numbers of those words that have a pair which fails."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        of = np.repeat(np.arange(len(words)), size)
        token = self.longest(data, ends[of])
        step, chosen = self.length[token], np.zeros(len(data), bool)
        at, end = (ends - size)[size > 0], ends[size > 0]
        while len(at) > FEW:
            chosen[at] = True
            at = at + step[at]
            at, end = at[at < end], end[at < end]
        for k, last in zip(at.tolist(), end.tolist(), strict=True):
            while k < last:
                chosen[k] = True
                k += int(step[k])
        flat, of = token[chosen], of[chosen]
        inner = np.flatnonzero(of[1:] == of[:-1])
        failing = np.unique(of[inner[~self.compatible(flat[inner], flat[inner + 1])]])
        return self._rows(flat, np.bincount(of, minlength=len(words))), failing

    def words_to_ids(self, words: Iterable[str]) -> list[tuple[int, ...]]:
        raw = [w.encode("utf-8", "replace") for w in words]
        out, failing = self.speculate(raw)
        short = [k for k in failing.tolist() if len(raw[k]) <= TOGETHER]
        for k, own in zip(short, self.merged_together([raw[k] for k in short]), strict=True):
            out[k] = own
        for k in failing.tolist():
            if len(raw[k]) > TOGETHER:
                out[k] = self.merged(raw[k])
        return list(map(tuple, out))

    @cached_property
    def splitter(self):
        from tokenizers import pre_tokenizers

        return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def words(self, text: str) -> Iterator[list[str]]:
        """The text's words in order, CHUNK at most at a time; special tokens' strings are words of their own."""
        at = 0
        for found in self.cut_special.finditer(text) if self.cut_special else ():
            yield from self._plain_words(text[at : found.start()])
            yield [found.group()]
            at = found.end()
        yield from self._plain_words(text[at:] if at else text)

    def _plain_words(self, text: str) -> Iterator[list[str]]:
        settled = SETTLED.fullmatch(text)
        if settled and len(text) <= CHUNK:
            yield PATTERN.findall(text)
            return
        each = (m.group() for m in PATTERN.finditer(text)) if settled else (text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text))
        while some := list(islice(each, CHUNK)):
            yield some

    def looked_up(self, texts: Iterable[str]) -> Iterator[tuple[int, list[tuple]]]:
        """(number of the text, its words) in order, each word as (ids, number of ids, decimal ids joined by commas,
        bytes that the ids decode to); a long text comes in several pieces."""
        held, n = [], 0
        for k, text in enumerate(texts):
            for some in self.words(text):
                held.append((k, some))
                n += len(some)
                if n >= CHUNK:
                    yield from self._known_words(held)
                    held, n = [], 0
        yield from self._known_words(held)

    def _known_words(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, list[tuple]]]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for t, k in self.special.items():
            known[t] = self._told((k,))
        fresh = list(set().union(*[words for _, words in held]).difference(known))
        known.update(zip(fresh, map(self._told, self.words_to_ids(fresh)), strict=True))
        for k, words in held:
            yield k, list(map(known.__getitem__, words))
        for w in fresh:
            if len(w) > SHORT:
                del known[w]

    def _told(self, ids: tuple[int, ...]) -> tuple:
        return ids, len(ids), ",".join([self.names[i] for i in ids]), self.raw(ids)

    def encoded(self, texts: Iterable[str]) -> Iterator[tuple[int, list[int]]]:
        """(number of the text, ids) in order; a long text comes in several pieces."""
        for k, words in self.looked_up(texts):
            yield k, list(chain.from_iterable([w[0] for w in words]))

    def encode(self, text: str) -> list[int]:
        return [i for _, ids in self.encoded([text]) for i in ids]

    def raw(self, ids: Iterable[int]) -> bytes:
        """The bytes of these ids; ids that the vocabulary does not have stand for nothing."""
        table, n = self.bytes, self.n
        return b"".join([table[i] for i in ids if 0 <= i < n])

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes that are not UTF-8 become U+FFFD."""
        return self.raw(ids).decode("utf-8", "replace")


class Utf8:
    """Decodes bytes that come in pieces, as UTF-8 again."""

    def __init__(self):
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, raw: bytes, last: bool = False) -> bytes:
        return self.decoder.decode(raw, last).encode()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Each Python worker holds its own."""
    return Vocabulary(path)


@contextmanager
def few_collections() -> Iterator[None]:
    """Collects garbage less often: what words are told by are many small tuples without cycles."""
    usual = gc.get_threshold()
    gc.set_threshold(500_000, 20, 100)
    try:
        yield
    finally:
        gc.set_threshold(*usual)


def plain(text: str | None) -> str:
    return text if isinstance(text, str) else ""


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with ``ids``, the token ids of their whole texts (null: none). Other columns stay as they are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(tokenizer)
        for frame in frames:
            out: list[list[int]] = [[] for _ in range(len(frame))]
            for k, some in words.encoded(map(plain, frame.iloc[:, at])):
                out[k] += some
            frame[ids] = pd.Series(out, index=frame.index, dtype=object)
            yield frame

    at = docs.columns.index(text)
    return mapped(docs, run, f"`{ids}` array<int>")


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with ``text``, what their ids stand for (null and empty: empty)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(tokenizer)
        for frame in frames:
            frame[text] = [words.decode([] if i is None else i.tolist()) for i in frame.iloc[:, at]]
            yield frame

    at = rows.columns.index(ids)
    return mapped(rows, run, f"`{text}` string")


def bpe_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """For every row: doc_id, the number of tokens, digests of the decimal ids joined by commas and of the text that
    they decode to. Null is empty; rows that share an id or a text, or have no id, are rows of their own; an empty
    table gives an empty result; other columns are not looked at. Texts go through in pieces of CHUNK words, so that
    ids of very long ones are never held at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(tokenizer)
        with few_collections():
            for frame in frames:
                n = [0] * len(frame)
                ids, text = [hashlib.sha256() for _ in n], [hashlib.sha256() for _ in n]
                decoders = {}
                for k, some in words.looked_up(map(plain, frame["text"])):
                    ids[k].update(("," if n[k] and some else "").encode() + ",".join([w[2] for w in some]).encode())
                    n[k] += sum([w[1] for w in some])
                    text[k].update(decoders.setdefault(k, Utf8()).push(b"".join([w[3] for w in some])))
                for k, d in decoders.items():
                    text[k].update(d.push(b"", True))
                yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_tokens": n, "ids_sha256": [h.hexdigest() for h in ids], "decoded_sha256": [h.hexdigest() for h in text]})

    own = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
