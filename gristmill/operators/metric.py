"""Exact nearest neighbours by metric partitions: pivots, distance intervals and triangle bounds.

Rows are dealt to their nearest pivot. For each partition the driver holds the least and greatest distance of its rows
to every pivot (a square of the pivots' number, PIVOTS at most). A query's distances to the pivots then bound its
distance to all rows of a partition from below. Each query first visits its nearest partitions, as many as hold k rows;
the k-th distance found there is a bound, and only partitions that may hold a nearer row are visited after that, and give only rows within the bound.
Queries and rows meet in blocks of bounded size; neither goes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.tables import stored

#: The most partitions; rows of a block and queries of a block.
PIVOTS, ROWS, QUERIES = 128, 4096, 2048
#: Queries whose distances to a block of rows are held at once.
CHUNK = 256
#: How much a bound may be off by rounding, relative to the distances it comes from.
SLACK = 1e-9


def vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros(0)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances, by differences: no cancellation."""
    out = np.empty((len(x), len(y)))
    n = x.shape[1] if x.ndim == y.ndim == 2 else 0
    if 1 < n < 8:  # a column at a time, added in the order in which numpy sums so few
        square = lambda c: (x[:, c, None] - y[:, c]) ** 2
        total = square(0)
        for c in range(1, n):
            total += square(c)
        return np.sqrt(total, out=total)
    for a in range(0, len(x), 64):
        out[a : a + 64] = np.sqrt(((x[a : a + 64, None] - y) ** 2).sum(2))
    return out


class MetricIndex:
    """``rows``: one row a key, with vectors of one length and no nulls. The rows are stored, dealt to partitions.
    ``block``: queries that meet a block of rows in one task."""

    def __init__(self, rows: DataFrame, key: str, vector: str, pivots: int | None = None, block: int | None = None):
        self.key, self.kind, self.block = key, rows.schema[key].dataType.simpleString(), block or QUERIES
        own = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
        n = own.count()
        p = pivots or int(np.clip((n / 64) ** 0.5, 1, PIVOTS))
        picked = own.orderBy(F.xxhash64("key"), "key").limit(p).collect()
        self.pivots = np.array([list(r["vector"]) for r in picked], np.float64)
        held = self.pivots

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    yield f.assign(part=distances(vectors(f["vector"]), held).argmin(1).astype(np.int32))

        self.rows = stored(own.mapInPandas(deal, f"key {self.kind}, vector array<double>, part int"), "metric-rows") if n else own.withColumn("part", F.lit(0))
        self._measure()

    def _measure(self) -> None:
        """Each partition's number of rows and its interval of distances to each pivot."""
        held, p = self.pivots, len(self.pivots)

        def spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, lo, hi = np.zeros(p, np.int64), np.full((p, p), np.inf), np.full((p, p), -np.inf)
            for f in frames:
                part = f["part"].to_numpy()
                d = distances(vectors(f["vector"]), held) if len(f) else np.zeros((0, p))
                n += np.bincount(part, minlength=p)
                np.minimum.at(lo, part, d)
                np.maximum.at(hi, part, d)
            at = np.flatnonzero(n)
            if len(at):
                yield pd.DataFrame({"part": at.astype(np.int32), "n": n[at], "lo": list(lo[at]), "hi": list(hi[at])})

        self.n, self.lo, self.hi = np.zeros(p, np.int64), np.full((p, p), np.inf), np.full((p, p), -np.inf)
        if not p:
            return
        each = self.rows.select("vector", "part").mapInPandas(spans, "part int, n long, lo array<double>, hi array<double>")
        ends = each.select("part", F.posexplode(F.arrays_zip("lo", "hi")).alias("pivot", "d")).groupBy("part", "pivot").agg(F.min("d.lo").alias("lo"), F.max("d.hi").alias("hi"))
        for r in ends.collect():
            self.lo[r["part"], r["pivot"]], self.hi[r["part"], r["pivot"]] = r["lo"], r["hi"]
        for r in each.groupBy("part").agg(F.sum("n").alias("n")).collect():
            self.n[r["part"]] = r["n"]

    def _plan(self, k: int) -> Callable[[np.ndarray, np.ndarray | None], np.ndarray]:
        """For a batch of queries: which partitions each visits first, or (with bounds) which after that."""
        pivots, n, lo, hi = self.pivots, self.n, self.lo, self.hi

        def visits(x: np.ndarray, bound: np.ndarray | None) -> np.ndarray:
            d = distances(x, pivots)
            order = np.argsort(d, axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            first = np.zeros(d.shape, bool)
            np.put_along_axis(first, order, (before < k + 1) & (n[order] > 0), 1)
            if bound is None:
                return first
            least = np.zeros(d.shape)
            for c in np.flatnonzero(n):
                least[:, c] = np.maximum(d - hi[c], lo[c] - d).max(1)
            return ~first & (n > 0) & (least <= bound[:, None] + SLACK * (1 + d.max(1))[:, None])

        return visits

    def _search(self, visits: DataFrame, k: int) -> DataFrame:
        """(query, key, distance): from (query, at, part, bound), the k nearest rows of each block that are not beyond
        the query's bound."""
        asked = visits.groupBy("part").agg(F.count("*").alias("asked"))
        cuts = asked.select("part", F.ceil(F.col("asked") / self.block).cast("int").alias("qs"), F.ceil(F.get(F.array(*[F.lit(int(v)) for v in self.n]), F.col("part")) / ROWS).cast("int").alias("rs"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        cuts = F.broadcast(cuts)  # PIVOTS rows at most
        x = visits.join(cuts, "part").select("part", own("query", "qs").alias("q"), each("rs").alias("r"), F.lit(True).alias("asks"), F.col("query").alias("key"), F.col("at").alias("vector"), "bound")
        y = self.rows.join(cuts, "part").select("part", each("qs").alias("q"), own("key", "rs").alias("r"), F.lit(False).alias("asks"), "key", "vector", F.lit(0.0).alias("bound"))

        def best(f: pd.DataFrame) -> pd.DataFrame:
            asks, has, out = f[f["asks"]], f[~f["asks"]].sort_values("key"), []
            keys, names = has["key"].to_numpy(), asks["key"].to_numpy()
            if len(asks) and len(has):
                at, rows, bounds = vectors(asks["vector"]), vectors(has["vector"]), asks["bound"].to_numpy(np.float64)
                for a in range(0, len(asks), CHUNK):
                    d, bound = distances(at[a : a + CHUNK], rows), bounds[a : a + CHUNK]
                    if len(keys) > k + 1:  # the query itself may be among them
                        bound = np.minimum(bound, np.partition(d, k, axis=1)[:, k])
                    i, j = np.nonzero(d <= bound[:, None])  # with all that tie
                    other = keys[j] != names[a + i]
                    i, j = i[other], j[other]
                    order = np.lexsort((j, d[i, j], i))
                    i, j = i[order], j[order]
                    near = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, j = i[near], j[near]
                    out.append(pd.DataFrame({"query": names[a + i], "key": keys[j], "distance": d[i, j]}))
            return pd.concat(out) if out else pd.DataFrame({"query": names[:0], "key": keys[:0], "distance": np.zeros(0)})

        return x.unionByName(y).groupBy("part", "q", "r").applyInPandas(best, f"query {self.kind}, key {self.kind}, distance double")

    def _visits(self, queries: DataFrame, k: int, bounded: bool) -> DataFrame:
        plan, kind = self._plan(k), self.kind

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    bound = f["bound"].to_numpy(np.float64) if bounded else np.full(len(f), np.inf)
                    i, part = np.nonzero(plan(vectors(f["at"]), bound if bounded else None))
                    yield f.iloc[i][["query", "at"]].assign(part=part.astype(np.int32), bound=bound[i])

        return queries.mapInPandas(run, f"query {kind}, at array<double>, part int, bound double")

    def nearest(self, queries: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
        """(query, key, distance, place): each query's k nearest rows, its own key left out, equal distances by key;
        and (query, visited, partitions). Queries have keys of their own and vectors of the rows' length."""
        asked = queries.select(F.col(f"`{key}`").alias("query"), F.col(f"`{vector}`").cast("array<double>").alias("at"))
        parts = int((self.n > 0).sum())
        if not parts:
            none = asked.limit(0)
            return none.select("query", F.col("query").alias(self.key), F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("place")), asked.select("query", F.lit(0).cast("long").alias("visited"), F.lit(0).cast("long").alias("partitions"))
        place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
        top = lambda df: df.withColumn("place", place.cast("long")).where(F.col("place") <= k)
        first = self._visits(asked, k, False)
        found = stored(top(self._search(first, k)), "metric-first")
        bounds = found.groupBy("query").agg(F.max("distance").alias("bound"), F.count("*").alias("n"))
        bound = F.when(F.col("n") >= k, F.col("bound")).otherwise(F.lit(float("inf")))
        held = asked.join(bounds, "query", "left").select("query", "at", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
        then = stored(self._visits(held, k, True), "metric-visits")
        more = self._search(then, k).unionByName(found.drop("place"))
        count = first.select("query").unionByName(then.select("query")).groupBy("query").agg(F.count("*").alias("visited"))
        told = asked.select("query").join(count, "query", "left").select("query", F.coalesce("visited", F.lit(0)).cast("long").alias("visited"), F.lit(parts).cast("long").alias("partitions"))
        return top(more).withColumnRenamed("key", self.key) if self.key != "key" else top(more), told
