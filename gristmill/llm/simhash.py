"""SimHash near-dedup: fingerprints, pivot distance tables, verified links and their components.

Distinct fingerprints that differ in at most RADIUS bits agree on one of RADIUS + 1 blocks of bits at least, so that
each fingerprint stands once under each of its blocks. A group of fingerprints that agree is split in the same way by
the bits that it does not yet agree on, for as long as it is larger than GROUP and such bits are left. In every group
the pivot table decides first: by the triangle inequality two fingerprints whose distances to any pivot differ by more
than the radius cannot link. Survivors are verified by their own Hamming distance. No step depends on how large a group
was at first: a fingerprint stands in at most 3 ** LEVELS groups, and what agrees on all split bits differs in LAST bits
at most, which bounds the last groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import as_came, bitmap, discard, looked_up, only, stored
from gristmill.llm.components import components

SEED = 42
SHINGLE = 3
RADIUS = 2
PIVOTS = 32
#: A larger group is split by the bits that it does not agree on, LEVELS times at most; LAST bits are then left.
GROUP, LEVELS, LAST = 48, 5, 10
#: Similar documents: the share of five-word shingles in common. Two texts with that share meet in one of BANDS keys of
#: BAND least hashes each with a chance of 1 - (1 - SIMILARITY ** BAND) ** BANDS = 0.99995, whatever the table's size.
SIMILARITY, SIMILAR_SHINGLE, BANDS, BAND = 0.8, 5, 25, 5
#: BLOCK: rows of a side of the blocks that one task compares at once; MOST_BITS bounds a bitmap of texts (16 MB). They
#: change the work, not the result.
BLOCK, MOST_BITS = 512, 27
#: Odd multipliers by rule, for word shingles and for each of the least hashes.
ODD = np.array([xxhash.xxh64_intdigest(f"odd {k}", SEED) | 1 for k in range(BANDS * BAND + 1)], np.uint64)
#: Bits that are set in each value of a byte.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits as a signed number; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not words:
        return 0
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([h(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    lanes = hashes.view(np.uint8).reshape(-1, 8).astype(np.int32) + np.arange(8, dtype=np.int32) * 256
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits((counts.ravel() * 2 > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: one row for each row of ``docs``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": np.array([fingerprint(t, shingle) for t in frame["text"]], np.int64)})

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints by rule: hashes of 0, 1, 2, ..."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(k), SEED)).astype(np.int64)) for k in range(n)]


def pivot_table(fps: DataFrame) -> DataFrame:
    """The frame with ``d``: each fingerprint's Hamming distances to the pivots."""
    return fps.withColumn("d", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in pivots()]))


def masks(level: int) -> list[int]:
    """The bits that the groups of a level agree on, by number; group k splits into groups 3 k to 3 k + 2."""
    if level < 0:
        return [0]
    out = []
    for known in masks(level - 1):
        left = [b for b in range(64) if not known >> b & 1]
        for part in np.array_split(left, RADIUS + 1):
            out.append(known | sum(1 << int(b) for b in part))
    return out


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def split(rows: DataFrame, level: int) -> DataFrame:
    """Rows (k, fp, d) of groups k one level up, each in the groups that its bits put it in: k, v, fp, d."""
    known = F.array(*[F.lit(signed(m)).cast("long") for m in masks(level)])
    parts = F.explode(F.array(*[F.col("k") * (RADIUS + 1) + j for j in range(RADIUS + 1)]))
    return rows.select(parts.alias("k"), "fp", "d").select("k", F.col("fp").bitwiseAND(F.get(known, F.col("k"))).alias("v"), "fp", "d")


def within(x: str, y: str) -> Column:
    """What the pivot table lets through: no coordinate differs by more than the radius."""
    return F.forall(F.zip_with(F.col(f"{x}.d"), F.col(f"{y}.d"), lambda p, q: F.abs(p - q)), lambda v: v <= RADIUS)


def links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints at most RADIUS bits apart, the smaller first."""
    rows, out = pivot_table(fps).select(F.lit(0).alias("k"), "fp", "d"), None
    for level in range(LEVELS):
        keyed = split(rows, level)
        sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
        keyed = stored(keyed.join(sizes, ["k", "v"]), "blocks")
        last = level == LEVELS - 1
        few = keyed if last else keyed.where(F.col("n") <= group)
        x, y = few.alias("x"), few.alias("y")
        met = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.v") == F.col("y.v")) & (F.col("x.fp") < F.col("y.fp")) & within("x", "y"))
        pairs = met.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        out = pairs if out is None else out.unionByName(pairs)
        rows = keyed.where(F.col("n") > group).select("k", "fp", "d")
        if last or rows.isEmpty():
            break
    return out.distinct()


def grouped(own: DataFrame, fps: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, fp, component_id from documents' fingerprints, distinct ones (fp, first_id) and (node, root) rows."""
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_tables(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    own = stored(fingerprints(docs, shingle), "fingerprints")
    return own, stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that the document's fingerprint reaches over links.

    Null and empty texts have fingerprint 0 and link like any other. Rows with the same doc_id or the same text are
    rows of their own. A row without doc_id gets a component like others, but is never its smallest id.
    """
    own, fps = fingerprint_tables(docs, shingle)
    return grouped(own, fps, components(links(fps.select("fp"))))


#: Hashes of words that a worker has met, MOST_WORDS about.
WORD_HASHES: dict[bytes, int] = {}
MOST_WORDS = 1 << 17


def shingle_keys(text: str | None, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the text's word shingles, each once; of the whole text if it has fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(WORD_HASHES) > MOST_WORDS:
        WORD_HASHES.clear()
    for w in set(words).difference(WORD_HASHES):
        WORD_HASHES[w] = xxhash.xxh64_intdigest(w, SEED)
    w = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * ODD[0]
        h ^= h >> np.uint64(31)
    return np.unique(h)


def least_hashes(keys: np.ndarray) -> np.ndarray:
    """For each of BANDS * BAND hash functions the least value over a text's shingles."""
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(keys), 4096):
        least = np.minimum(least, (keys[None, at : at + 4096] * ODD[1:, None]).min(1))
    return least


def banded(least: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(BAND):
        out = (out ^ least.reshape(BANDS, BAND)[:, j]) * ODD[0]
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def band_keys(keys: np.ndarray) -> np.ndarray:
    """One key for each band from the least hashes of a text's shingles; none for a text without words."""
    return banded(least_hashes(keys)) if len(keys) else np.zeros(0, np.int64)


def sketch(least: np.ndarray) -> bytes:
    """A byte of each least hash: two texts agree in about as large a share of them as they do in shingles."""
    return ((least * ODD[0]) >> np.uint64(56)).astype(np.uint8).tobytes()


def least_agreement(similarity: float) -> int:
    """Bytes of a sketch in which texts of that similarity agree but for a chance of some 4e-5 (four deviations)."""
    n = BANDS * BAND
    return max(0, int(n * similarity - 4 * (n * similarity * (1 - similarity)) ** 0.5))


def text_marks(text: Column) -> list[Column]:
    """128 bits drawn from SHA-256 that stand for a text, as two numbers; null has its own."""
    digest = F.coalesce(F.sha2(text, 256), F.lit("0" * 64))
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "h1"), (17, "h2"))]


def text_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2) for every row, and the distinct texts: node (a number of their own), h1, h2, fp, n (shingles),
    keys and sketch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for t in f["text"]:
                keys = shingle_keys(t)
                least = least_hashes(keys)
                rows.append((fingerprint(t), len(keys), banded(least) if len(keys) else [], sketch(least)))
            yield f[["doc_id", "h1", "h2"]].astype({"doc_id": "Int64"}).join(pd.DataFrame(rows, columns=["fp", "n", "keys", "sketch"], index=f.index))

    own = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), *text_marks(F.col("text")), "text")
    rows = stored(own.mapInPandas(run, "doc_id long, h1 long, h2 long, fp long, n int, keys array<long>, sketch binary"), "fingerprints")
    same = rows.groupBy("h1", "h2").agg(*[F.any_value(c).alias(c) for c in ("fp", "n", "keys", "sketch")])
    return rows.select("doc_id", "h1", "h2"), stored(same.select(F.monotonically_increasing_id().alias("node"), "*"), "distinct-texts")


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """(a, b): enough pairs of nodes with fingerprints at most RADIUS bits apart to join all that such pairs join."""
    fps = stored(nodes.groupBy("fp").agg(F.min("node").alias("node")), "distinct-fingerprints")
    at = lambda side: fps.select(F.col("fp").alias(side), F.col("node").alias(f"n{side}"))
    near = links(fps.select("fp")).join(at("a"), "a").join(at("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    same = nodes.select("fp", F.col("node").alias("a")).join(fps.withColumnRenamed("node", "b"), "fp").where("a != b").select("a", "b")
    return near.unionByName(same)


def at_roots(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, node) with their groups' roots, of those keys that more than one group has."""
    named = keyed.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    return named.join(open_, "key", "left_semi")


def best_hubs(open_: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, other): each node with the likeliest of its keys' hubs, by their sketches, if that is of another group
    and may be similar. A key's hub is the node that meets most others: in a group of edited copies the least edited."""
    sizes = open_.groupBy("key").agg(F.count("*").alias("n"))
    met = open_.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("met"))
    hubs = open_.join(met, "node").groupBy("key").agg(F.max_by(F.struct(F.col("node").alias("other"), F.col("root").alias("far")), F.struct("met", "node")).alias("y"))
    pairs = open_.join(hubs.select("key", "y.*"), "key").where("root != far").select("node", "other").distinct()
    marks = nodes.select("node", "n", "sketch")
    both = looked_up(pairs.join(marks, "node"), marks.select(F.col("node").alias("other"), F.col("n").alias("m"), F.col("sketch").alias("far")), ["other"])
    both = both.where(F.least("n", "m") >= F.greatest("n", "m") * similarity - 1e-9)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in filter(len, frames):
            x, y = (np.frombuffer(b"".join(f[c]), np.uint8).reshape(len(f), -1) for c in ("sketch", "far"))
            yield f[["node", "other"]].assign(alike=(x == y).sum(1).astype(np.int32))

    told = both.select("node", "other", "sketch", "far").mapInPandas(run, "node long, other long, alike int").where(F.col("alike") >= least_agreement(similarity))
    return told.groupBy("node").agg(F.max_by("other", F.struct("alike", "other")).alias("other"))


def star_blocks(pairs: DataFrame) -> DataFrame:
    """(key, px, py, side, node): blocks of one hub (side 0) and some of its partners, BLOCK at most."""
    counted = pairs.groupBy("other").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("px")
    partners = pairs.join(counted, "other").select(F.col("other").alias("key"), part, F.lit(0).alias("py"), F.lit(1).alias("side"), "node")
    hubs = counted.select(F.col("other").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("px"), F.lit(0).alias("py"), F.lit(0).alias("side"), F.col("other").alias("node"))
    return partners.unionByName(hubs)


def pair_blocks(open_: DataFrame) -> DataFrame:
    """(key, px, py, side, node, root): blocks of all pairs from different groups that share a key. Of two groups one
    is not the key's largest: its rows (side 0) meet all of the key's rows (side 1), BLOCK of each at a time."""
    most = open_.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
    most = most.agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("rows"), F.max("n").alias("largest"))
    cuts = lambda n: F.ceil(n / BLOCK).cast("int")
    named = open_.join(most.select("key", "main", cuts(F.col("rows") - F.col("largest")).alias("xs"), cuts(F.col("rows")).alias("ys")), "key")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    x = named.where("root != main").select("key", own("xs").alias("px"), each("ys").alias("py"), F.lit(0).alias("side"), "node", "root")
    y = named.select("key", each("xs").alias("px"), own("ys").alias("py"), F.lit(1).alias("side"), "node", "root")
    return x.unionByName(y)


def may_link(x: pd.DataFrame, y: pd.DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose sizes and sketches allow the similarity; of a block of all pairs those alone from
    different groups whose first common key this is."""
    nx, ny = (f["n"].to_numpy(np.float64) for f in (x, y))
    ok = np.minimum(nx[:, None], ny) >= np.maximum(nx[:, None], ny) * similarity - 1e-9
    if "root" in x:
        ok &= x["root"].to_numpy()[:, None] != y["root"].to_numpy()
    i, j = np.nonzero(ok)
    sx, sy = (np.frombuffer(b"".join(f["sketch"]), np.uint8).reshape(len(f), -1) for f in (x, y))
    alike = np.concatenate([np.zeros(0, bool)] + [(sx[i[a : a + 4096]] == sy[j[a : a + 4096]]).sum(1) >= least_agreement(similarity) for a in range(0, len(i), 4096)])
    i, j = i[alike], j[alike]
    if "root" in x and len(i):
        kx, ky = np.stack(x["keys"].to_list()), np.stack(y["keys"].to_list())
        common = kx[i] == ky[j]
        first = kx[i, common.argmax(1)] == x["key"].iloc[0]
        i, j = i[first], j[first]
    return i, j


def block_links(blocks: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of nodes of the blocks with that share of shingles in common, by their whole texts. Texts go
    only to those blocks in which the sketches leave them a partner."""
    by = ["key", "px", "py"]
    rooted = "root" in blocks.columns
    parts = [*by, "side", "node", *(["root"] if rooted else [])]
    schema = "key long, px int, py int, side int, node long" + (", root long" if rooted else "")
    light = blocks.join(nodes.select("node", "n", "keys", "sketch"), "node")

    def sides(f: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        return tuple(f[f["side"] == k].reset_index(drop=True) for k in (0, 1))

    def left(f: pd.DataFrame) -> pd.DataFrame:
        x, y = sides(f)
        i, j = may_link(x, y, similarity) if len(x) and len(y) else ([], [])
        return pd.concat([x.iloc[np.unique(i)], y.iloc[np.unique(j)]])[parts]

    asked = stored(light.groupBy(*by).applyInPandas(left, schema), "asked-blocks")

    def compared(f: pd.DataFrame) -> pd.DataFrame:
        x, y = sides(f)
        kept = []
        if len(x) and len(y):
            sx, sy = ([shingle_keys(t) for t in g["text"]] for g in (x, y))
            for i, j in zip(*may_link(x, y, similarity), strict=True):
                same = len(np.intersect1d(sx[i], sy[j], assume_unique=True))
                if same and same >= similarity * (len(sx[i]) + len(sy[j]) - same) - 1e-9:
                    kept.append((x["node"][i], y["node"][j]))
        return pd.DataFrame(kept, columns=["a", "b"], dtype=np.int64)

    full = asked.join(nodes.select("node", "n", "keys", "sketch"), "node").join(texts, "node")
    return full.groupBy(*by).applyInPandas(compared, "a long, b long").where("a != b")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of these nodes. A bitmap of bounded size keeps most other texts from being shuffled."""
    bits = min(MOST_BITS, max(10, (8 * nodes.count()).bit_length()))
    held = bitmap(nodes.select(F.col("h1").alias("hash")), bits)

    @F.pandas_udf("boolean")
    def wanted(h: pd.Series) -> pd.Series:
        own = np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little")
        return pd.Series(own[h.to_numpy() & ((1 << bits) - 1)] > 0)

    own = docs.select(*text_marks(F.col("text")), "text").where(wanted("h1"))
    each = own.groupBy("h1", "h2").agg(F.any_value("text").alias("text"))
    return stored(each.join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("node", "text"), "asked-texts")


def similar_roots(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2) for every row, and (h1, h2, fp, root) for every text.

    Fingerprints within RADIUS bits link at once. Then texts meet in keys of least hashes, whose number does not depend
    on the table: first each is compared with the likeliest of its keys' hubs, which joins most of a group of copies,
    and then all pairs that share a key and still lead from one group to another are. What sizes and sketches leave
    is compared by whole texts.
    """
    rows, nodes = text_nodes(docs)
    roots = components(fingerprint_links(nodes))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key", "left_semi")
    open_ = stored(at_roots(shared, roots), "open-keys")
    asked = stored(nodes.join(open_.select("node").distinct(), "node", "left_semi"), "asked-nodes")
    texts = texts_of(only(docs, "text"), asked)
    spent = [open_, asked, texts]
    for step in range(2):
        blocks = pair_blocks(open_) if step else star_blocks(stored(best_hubs(open_, asked, similarity), "hubs"))
        more = block_links(blocks, asked, texts, similarity)
        roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        if not step:
            open_ = stored(at_roots(open_, roots), "open-keys")
            spent.append(open_)
    discard(*spent)
    named = nodes.select("node", "h1", "h2", "fp").join(roots, "node", "left")
    return rows, named.select("h1", "h2", "fp", F.coalesce("root", "node").alias("root"))


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """As ``near_groups``, with further links between documents of at least SIMILARITY in their five-word shingles.
    Null, empty and repeated rows as there; texts are told apart by 128 bits."""
    rows, texts = similar_roots(docs, similarity)
    rooted = rows.join(texts, ["h1", "h2"])
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "fp", "component_id")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of similar texts: the one with the smallest doc_id, of rows that share that id the text
    with the least mark, of rows that share both any one. A doc_id that several texts have does not make them alike:
    each stays if it is its group's choice. Rows without doc_id stay, since nothing names them. Columns as they came."""
    rows, texts = similar_roots(docs)
    named = rows.where("doc_id is not null")
    keepers = named.join(texts, ["h1", "h2"]).groupBy("root").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("k")).select("k.*")
    id_, h1, h2 = "__doc_id", "__h1", "__h2"
    keepers = keepers.toDF(id_, h1, h2)
    whole = docs.where(F.col("doc_id").isNotNull()).select(*as_came(docs), F.col("doc_id").cast("long").alias(id_), *(m.alias(n) for m, n in zip(text_marks(F.col("text")), (h1, h2), strict=True)))
    kept = whole.join(keepers, [id_, h1, h2], "left_semi")
    if not named.groupBy("doc_id", "h1", "h2").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_, h1, h2])
    return kept.select(*as_came(docs)).unionByName(docs.where(F.col("doc_id").isNull()).select(*as_came(docs)))


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in 16 hex digits, component_id for every row; cases as in ``near_groups``. An empty table
    gives an empty result, other columns are not looked at, texts are read whole."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
