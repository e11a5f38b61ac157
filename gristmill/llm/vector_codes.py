"""Vectors as short codes: integer parts, a codebook for each part, nearest entries by segment-mean lower bounds.

A part is cut into 1, 2, 4, ... blocks. At each level the block means and the norm of what the means leave bound the
distance from below: sum of size * (difference of means)^2 plus (difference of residual norms)^2. From coarse to fine,
entries whose bound is above a distance already known are dropped; those that survive the last level get their exact
integer distance. Bounds are computed in doubles and compared with a slack far above their rounding, so that no nearest
entry is lost, and integers decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import only, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose bounds are held at once; the slack of a bound, relative to the squared norms.
CHUNK, SLACK = 512, 1e-9
#: A label with more than this share of the rows has its sum sent to all tasks (there are HOT of those at most).
HOT = 1000


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    x = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, x), F.lit(False))


def integers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are usable, and floor(SCALE * x) of those, with zeros up to ``width`` components."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64())  # null components become nan
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    of = np.repeat(np.arange(len(size)), size)
    good = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
    good[of[~np.isfinite(values)]] = False
    at = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(size), width))
    inside = good[of]
    with np.errstate(over="ignore"):
        out[of[inside], at[inside]] = np.floor(values[inside] * SCALE)
    out = out[good]
    if out.size and np.abs(out).max() > largest(width):
        raise ValueError(f"components beyond {largest(width) / SCALE} have no exact distances in 64 bits")
    return good, out.astype(np.int64)


def largest(width: int) -> float:
    """Below it, all squared distances and their sums over parts fit in 62 bits."""
    return 2.0**29 / max(width, 1) ** 0.5


class Codebook:
    """The entries (integers, one a row) of one part."""

    def __init__(self, entries: np.ndarray):
        self.entries, d = entries, entries.shape[1]
        self.levels = [np.arange(b) * d // b for b in (2**k for k in range(20)) if b <= max(1, d // 2)] if d else []
        self.marks = [self.features(entries, cuts) for cuts in self.levels]
        self.norms = (entries.astype(np.float64) ** 2).sum(1)

    @staticmethod
    def features(rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """A row's block means times the roots of the blocks' sizes, and the norm of the rest: distances between such
        rows are lower bounds of distances between the rows themselves."""
        size = np.diff(np.r_[cuts, rows.shape[1]])
        means = np.add.reduceat(rows.astype(np.float64), cuts, axis=1) / size
        rest = rows - np.repeat(means, size, axis=1)
        return np.c_[means * np.sqrt(size), np.sqrt((rest**2).sum(1))]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each row's nearest entry (the lowest of equal ones), its exact squared distance, and the number of exact
        distances computed."""
        got = [self._nearest(rows[k : k + CHUNK]) for k in range(0, len(rows), CHUNK)]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(g[0] for g in got)]), np.concatenate([none, *(g[1] for g in got)]), sum(g[2] for g in got)

    def _exact(self, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return ((rows[i] - self.entries[j]) ** 2).sum(1)

    def _nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n = len(rows)
        slack = SLACK * ((rows.astype(np.float64) ** 2).sum(1) + self.norms.max() + 1)
        i, j = np.repeat(np.arange(n), len(self.entries)), np.tile(np.arange(len(self.entries)), n)
        known = np.full(n, np.inf)
        for cuts, marks in zip(self.levels, self.marks, strict=True):
            own = self.features(rows, cuts)
            bound = ((own**2).sum(1)[:, None] + (marks**2).sum(1) - 2 * own @ marks.T)[i, j]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            least = np.repeat(np.minimum.reduceat(bound, first), np.diff(np.r_[first, len(i)]))
            best = np.flatnonzero(bound == least)
            best = best[np.r_[True, i[best[1:]] != i[best[:-1]]]]
            known = np.minimum(known, self._exact(rows, i[best], j[best]))
            stay = bound <= (known + slack)[i]
            i, j = i[stay], j[stay]
        exact = self._exact(rows, i, j)
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        least = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == np.repeat(least, np.diff(np.r_[first, len(i)])))
        hit = hit[np.r_[True, i[hit[1:]] != i[hit[:-1]]]]
        return j[hit], least, len(i)


def split(rows: np.ndarray) -> list[np.ndarray]:
    d = rows.shape[1] // PARTS
    return [rows[:, p * d : (p + 1) * d] for p in range(PARTS)]


def first_books(vectors: DataFrame, column: str, key: str, width: int) -> list[np.ndarray]:
    """The parts of the usable vectors with the ENTRIES smallest keys; of equal keys the smaller vector first, null
    keys last."""
    rows = vectors.where(usable(F.col(column))).orderBy(F.col(key).asc_nulls_last(), F.col(column)).select(column).limit(ENTRIES).collect()
    return split(integers(pa.array([r[0] for r in rows], pa.list_(pa.float64())), width)[1])


def sums(vectors: DataFrame, column: str, books: list[np.ndarray], width: int) -> DataFrame:
    """(part, entry, n, at, total): how many parts each entry has and the sums of their components, for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        n = np.zeros((PARTS, ENTRIES), np.int64)
        total = np.zeros((PARTS, ENTRIES, width // PARTS), np.int64)
        for batch in batches:
            for p, rows in enumerate(split(integers(batch.column(0), width)[1])):
                code = own[p].nearest(rows)[0]
                n[p] += np.bincount(code, minlength=ENTRIES)
                for k in range(rows.shape[1]):  # doubles hold these sums exactly
                    total[p, :, k] += np.bincount(code, rows[:, k], ENTRIES).astype(np.int64)
        part, entry = np.nonzero(n)
        if len(part):
            yield pa.RecordBatch.from_pydict({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": n[part, entry], "totals": pa.array(list(total[part, entry]), pa.list_(pa.int64()))})

    each = only(vectors, column).mapInArrow(run, "part int, entry int, n long, totals array<long>")
    apart = each.select("part", "entry", "n", F.posexplode("totals").alias("at", "total"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    return apart.groupBy("part", "entry", "at").agg(wide("n"), wide("total"))


def trained(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """The codebooks after ``rounds`` of assignment and means, and the width of all vectors. What comes to the driver
    and goes to all tasks is ENTRIES entries a part."""
    longest = vectors.where(usable(F.col(column))).agg(F.max(F.size(column))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    books = first_books(vectors, column, key, width)
    for _ in range(rounds if len(books[0]) else 0):
        new = [b.copy() for b in books]
        for r in sums(vectors, column, books, width).collect():
            new[r["part"]][r["entry"], r["at"]] = int(r["total"]) // int(r["n"])
        books = new
    return books, width


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], width: int, column: str = "embedding", *also: str) -> DataFrame:
    """The usable rows' columns ``also``, their code (two hex digits a part) and the error (sum of the parts' squared
    distances)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        names = np.array([f"{k:02x}" for k in range(ENTRIES)], object)
        for batch in batches:
            good, rows = integers(batch.column(0), width)
            if not len(rows):
                continue
            got = [own[p].nearest(part) for p, part in enumerate(split(rows))]
            code = names[got[0][0]]
            for g in got[1:]:
                code = code + names[g[0]]
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*kept.columns[1:], pa.array(code, pa.string()), pa.array(sum(g[1] for g in got), pa.int64())], names=[*also, "code", "error"])

    own = only(vectors, column, *also)
    kinds = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in also)
    return own.mapInArrow(run, f"{kinds}{', ' if also else ''}code string, error long")


def decode(codes: DataFrame, books: list[np.ndarray], code: str = "code", vector: str = "approximation") -> DataFrame:
    """The rows with the vectors that their codes stand for: the entries one after the other, over SCALE."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in b.tolist()]) for b in books])
    entry = lambda p: F.get(F.get(table, F.lit(p)), F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int"))
    return codes.withColumn(vector, F.transform(F.concat(*[entry(p) for p in range(PARTS)]), lambda x: x / SCALE))


def with_label_errors(rows: DataFrame) -> DataFrame:
    """Rows with ``label`` and ``error``, with label_error. Labels of many rows, of which there are HOT at most, have
    their sums sent to all tasks; the others meet theirs in a join on the label."""
    each = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    n = each.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > n
    side = lambda which: each.where(which).select(F.col("label").alias("__label"), "label_error")
    met = rows.join(F.broadcast(side(hot)), F.col("label").eqNullSafe(F.col("__label")), "left").drop("__label")
    rest = met.where("label_error is null").drop("label_error").join(side(~hot), F.col("label").eqNullSafe(F.col("__label")))
    return met.where("label_error is not null").unionByName(rest.drop("__label"))


def vector_code_report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row whose vector is usable.

    Rows that share an id or a vector, or have no id, are rows of their own. Vectors are cut alike: the longest one's
    length, raised to a multiple of four, holds for all, and shorter ones count as zero beyond their end (an empty one
    is all zero). With fewer than 256 rows there are fewer entries; an empty table gives an empty result. Components
    whose distances would not fit in 64 bits are refused. Other columns are not looked at.
    """
    own = only(vectors, "embedding", "vec_id", "label")
    books, width = trained(own)
    rows = stored(encode(own, books, width, "embedding", "vec_id", "label"), "vector-codes")
    return with_label_errors(rows).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """The same rows in SQL, for vectors of one length that four divides."""
    step = """
a{k} AS MATERIALIZED (
  SELECT row, vec_id, label, p, x, min(struct_pack(d := nx + nc - 2 * list_dot_product(x, c), j := j)) AS best
  FROM parts JOIN c{k} USING (p) GROUP BY row, vec_id, label, p, x)"""
    update = """,
m{k} AS MATERIALIZED (
  SELECT p, j, list((t - ((t % n) + n) % n) // n ORDER BY pos)::DOUBLE[] AS c FROM (
    SELECT p, best.j AS j, pos, sum(x[pos]::BIGINT) AS t, count(*) AS n
    FROM a{k}, unnest(range(1, len(x) + 1)) AS u(pos) GROUP BY ALL) GROUP BY ALL),
c{n} AS MATERIALIZED (
  SELECT p, j, c, list_dot_product(c, c) AS nc FROM (
    SELECT o.p, o.j, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m USING (p, j))),"""
    rounds_sql = "".join(step.format(k=k) + (update.format(k=k, n=k + 1) if k < rounds else "") for k in range(rounds + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT *, list_dot_product(x, x) AS nx FROM (
    SELECT row, vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x
    FROM kept, unnest(range({PARTS})) AS u(p))),
c0 AS MATERIALIZED (
  SELECT p, j, x AS c, nx AS nc FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j FROM parts)
  WHERE j < {ENTRIES}),{rounds_sql},
codes AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', best.j), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
  FROM a{rounds} GROUP BY row, vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, j)) FROM c{rounds})
    AS codebooks_sha256
FROM codes"""


ORACLE_SQL = oracle()
