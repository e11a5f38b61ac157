"""Regression trees on rows that stay where they are: bagged, extremely random and boosted, with folds held out.

Columns are cut into bins once. Trees grow level by level, all trees (and the trees of all folds) together: one pass
sums weight, target and squared target by tree, node, column and bin, every task for its own rows; Spark adds the sums
up by place, and the best cuts are found on the driver from histograms whose size is that of the trees, not of the
table. A row finds its node by walking the trees that are known so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.exact import finite, quantiles
from gristmill.operators.latent import ridge, summed
from gristmill.tables import discard, stored

#: Ranges of a column, besides the one of missing values.
BINS = 32


@dataclass
class Binned:
    """Rows (key, seed, fold, x, v, y): bin numbers of the columns (0 where missing, else 1 + the number of edges below
    the value), their values, the target (nan where there is none) and a fold by hash of the key."""

    rows: DataFrame
    key: str
    columns: list[str]
    edges: list[np.ndarray]
    folds: int

    @classmethod
    def of(cls, df: DataFrame, key: str, columns: Sequence[str], target: str, folds: int = 5, bins: int = BINS) -> Binned:
        """A column with at most ``bins`` distinct values is cut between all of them, others at exact percentiles."""
        own = stored(df.select(F.col(f"`{key}`").alias(key), F.xxhash64(F.col(f"`{key}`")).alias("seed"), *[finite(c).alias(f"c{i}") for i, c in enumerate(columns)], F.coalesce(finite(target), F.lit(float("nan"))).alias("y")), "tree-raw")
        names = [f"c{i}" for i in range(len(columns))]
        n = own.agg(*[F.count_distinct(c).alias(c) for c in names]).first()
        few = [c for c in names if n[c] <= bins]
        cells = own.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in few])).alias("x")).select("x.*").where("v is not null").distinct().collect() if few else []
        values: dict[str, list[float]] = {c: [] for c in names}
        for r in cells:
            values[r["c"]].append(r["v"])
        for c, q in quantiles(own, {c: [k / bins for k in range(1, bins)] for c in names if c not in few}).items():
            values[c] = sorted(set(q))
        edges = [np.array(sorted(v))[: -1 if c in few else None] for c, v in values.items()]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                cut = [np.where(f[c].isna(), 0, 1 + np.searchsorted(e, f[c].to_numpy(np.float64), "left")) for c, e in zip(names, edges, strict=True)]
                x, v = (list(np.stack(a, 1)) if len(f) else [] for a in (cut, [f[c].to_numpy(np.float64) for c in names]))
                fold = (mixed(f["seed"].to_numpy(), 7) % np.uint64(max(folds, 1))).astype(np.int32)
                yield f[[key, "seed", "y"]].assign(fold=fold, x=pd.Series(x, index=f.index, dtype=object), v=pd.Series(v, index=f.index, dtype=object))

        kind = own.schema[key].dataType.simpleString()
        out = own.mapInPandas(run, f"`{key}` {kind}, seed long, y double, fold int, x array<int>, v array<double>")
        rows = stored(out, "tree-rows")
        discard(own)
        return cls(rows, key, list(columns), edges, folds)


def mixed(seed: np.ndarray, salt: int) -> np.ndarray:
    """Numbers by rule from a row's seed and a salt, spread over 64 bits."""
    with np.errstate(over="ignore"):
        h = seed.astype(np.int64).view(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 1) % 2**64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def grid(lists: pd.Series) -> np.ndarray:
    """Lists of one length as the rows of an array."""
    return np.concatenate(lists.to_numpy()).astype(np.float64).reshape(len(lists), len(lists.iloc[0]))


#: Chances that a row is drawn at most 0, 1, 2, ... times into a sample of the table's size.
DRAWN = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040], float))


def draws(seed: np.ndarray, salt: int) -> np.ndarray:
    return np.searchsorted(DRAWN, (mixed(seed, salt) >> np.uint64(11)).astype(np.float64) / 2**53).astype(np.float64)


class Tree:
    """Nodes in heap order: column (-1 at a leaf), the last bin that goes left, and the value."""

    def __init__(self, depth: int):
        n = 2 ** (depth + 1) - 1
        self.column, self.cut, self.value = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)

    def nodes(self, x: np.ndarray, levels: int | None = None) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(levels if levels is not None else int(np.log2(len(self.value) + 1)) - 1):
            c = self.column[at]
            right = x[rows, np.maximum(c, 0)] > self.cut[at]
            at = np.where(c >= 0, 2 * at + 1 + right, at)
        return at


@dataclass
class Ensemble:
    """What trees have in common: values add up, each group (one for each fold, and the last for all rows) by itself."""

    depth: int = 6
    least: int = 5
    share: float = 1.0
    seed: int = 0
    trees: list[list[Tree]] = field(default_factory=list)
    base: list[float] = field(default_factory=list)
    scale: float = 1.0
    gains: np.ndarray | None = None

    def predicted(self, x: np.ndarray, group: int) -> np.ndarray:
        return self.base[group] + self.scale * sum((t.value[t.nodes(x)] for t in self.trees[group]), np.zeros(len(x)))

    def outputs(self, x: np.ndarray, fold: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The prediction of the model of all rows, and that of the model which has not seen the row."""
        whole, apart = self.predicted(x, len(self.base) - 1), np.zeros(len(x))
        for g in range(len(self.base) - 1):
            apart[fold == g] = self.predicted(x[fold == g], g)
        return whole, apart if len(self.base) > 1 else whole

    def importances(self) -> np.ndarray:
        """Each column's share of what the cuts take off the squared error, in the model of all rows."""
        total = self.gains.sum()
        return self.gains / total if total > 0 else self.gains

    def grow(self, data: Binned, new: list[tuple[int, Tree, int]], weigh: Callable, aim: Callable, random_cuts: bool = False) -> None:
        """Fits trees (group, tree, salt) at once. ``weigh`` (seed, salt) and ``aim`` (x, y, group) give rows' weights
        and targets."""
        p, bins, folds = len(data.columns), max((len(e) for e in data.edges), default=0) + 2, len(self.base) - 1
        if self.gains is None:
            self.gains = np.zeros(p)
        cells = [F.get("x", F.lit(i)).alias(f"x{i}") for i in range(p)]
        open_ = [(k, 0) for k in range(len(new))]
        for level in range(max(self.depth, 1)):
            slot = np.full((len(new), 2**level), -1)
            for s, (k, node) in enumerate(open_):
                slot[k, node - (2**level - 1)] = s
            spans = [(int(own[own >= 0].min()), int(own.max()) + 1) if (own >= 0).any() else (0, 0) for own in slot]  # a tree's slots follow each other
            size = p * bins * 3

            def add(f: pd.DataFrame, slot=slot, level=level, size=size, spans=spans, n=len(open_)) -> np.ndarray:
                y, seed, fold = f["y"].to_numpy(np.float64), f["seed"].to_numpy(), f["fold"].to_numpy()
                out, known = np.zeros((n, p, bins, 3)), ~np.isnan(y)
                x = f[[f"x{i}" for i in range(p)]].to_numpy(np.int64)[known]
                y, seed, fold = y[known], seed[known], fold[known]
                aims: dict[int, np.ndarray] = {}
                weights: dict[int, np.ndarray] = {}
                for k, (group, tree, salt) in enumerate(new):
                    lo, hi = spans[k]
                    if lo == hi:
                        continue
                    if group not in aims:
                        aims[group] = aim(x, y, group)
                    if salt not in weights:
                        weights[salt] = weigh(seed, salt)
                    at = tree.nodes(x, level) - (2**level - 1)
                    w = weights[salt] if group == folds else weights[salt] * (fold != group)
                    s = np.where((at >= 0) & (w > 0), slot[k][np.maximum(at, 0)], -1)
                    in_ = np.flatnonzero(s >= 0)
                    t, w, s, own = aims[group][in_], w[in_], (s[in_] - lo) * bins, x[in_]
                    wt = w * t
                    for c in range(p):
                        place = s + own[:, c]
                        for v, what in enumerate((w, wt, wt * t) if c == 0 else (w, wt)):  # the squares are the same in all columns
                            out[lo:hi, c, :, v] += np.bincount(place, what, (hi - lo) * bins).reshape(-1, bins)
                return out.ravel()

            sums = summed(data.rows, [*cells, "y", "seed", "fold"], add, len(open_) * size).reshape(len(open_), p, bins, 3)
            next_ = []
            for s, (k, node) in enumerate(open_):
                group, tree, salt = new[k]
                n, t, _ = sums[s, 0].sum(0) if p else (0, 0, 0)
                tree.value[node] = t / n if n else 0.0
                best = None if level == self.depth or n < 2 * self.least else self._cut(sums[s], salt * 1_000_003 + node, random_cuts)
                if best:
                    gain, c, cut = best
                    tree.column[node], tree.cut[node] = c, cut
                    for child, part in ((2 * node + 1, sums[s, c, : cut + 1]), (2 * node + 2, sums[s, c, cut + 1 :])):  # leaves need no pass
                        n, t = part[:, :2].sum(0)
                        tree.value[child] = t / n
                    if group == folds:
                        self.gains[c] += gain
                    next_ += [(k, 2 * node + 1), (k, 2 * node + 2)]
            open_ = next_
            if not open_:
                break

    def _cut(self, h: np.ndarray, salt: int, random_cuts: bool) -> tuple[float, int, int] | None:
        """(gain, column, last bin to the left) of the cut that takes most off the squared error; the first of equals."""
        left = h.cumsum(1)
        n, t = left[..., 0], left[..., 1]
        all_n, all_t = n[:, -1:], t[:, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = t * t / n + (all_t - t) ** 2 / (all_n - n) - all_t**2 / all_n
        ok = (n >= self.least) & (all_n - n >= self.least) & (h[..., 0] > 0)
        rng = np.random.default_rng([abs(self.seed), salt])
        if self.share < 1:
            ok[rng.permutation(len(h))[max(1, round(self.share * len(h))) :]] = False
        if random_cuts:
            for c in range(len(h)):
                some = np.flatnonzero(ok[c])
                if len(some):
                    pick = some[rng.integers(len(some))]
                    ok[c] = False
                    ok[c, pick] = True
        gain = np.where(ok, gain, -np.inf)
        c, b = divmod(int(gain.argmax()), gain.shape[1])
        floor = 1e-10 * max(h[0, :, 2].sum(), 1e-300)
        return (float(gain[c, b]), c, b) if gain[c, b] > floor else None

    def _start(self, data: Binned, level: bool) -> None:
        """The groups' mean targets where trees add to it, else nothing."""
        folds = data.folds if data.folds > 1 else 0

        def add(f: pd.DataFrame) -> np.ndarray:
            y, fold = f["y"].to_numpy(np.float64), f["fold"].to_numpy()
            known = ~np.isnan(y)
            return np.concatenate([[known[m].sum(), y[m & known].sum()] for m in [*(fold != g for g in range(folds)), fold >= 0]])

        s = summed(data.rows, ["y", "fold"], add, 2 * (folds + 1)).reshape(-1, 2) if level else np.zeros((folds + 1, 2))
        self.base = [float(t / n) if n else 0.0 for n, t in s]
        self.trees = [[] for _ in self.base]


@dataclass
class Forest(Ensemble):
    """Means of trees on samples drawn with replacement, or (``random_cuts``) on all rows with one cut drawn for each
    column of a node."""

    n_trees: int = 20
    random_cuts: bool = False

    def fit(self, data: Binned, together: int = 64) -> Forest:
        self._start(data, False)
        self.scale = 1 / self.n_trees
        new = []
        for k in range(self.n_trees):
            for g in range(len(self.base)):
                self.trees[g].append(Tree(self.depth))
                new.append((g, self.trees[g][-1], self.seed * 10_007 + k))
        for a in range(0, len(new), together):  # bounds the histograms of a pass
            self.grow(data, new[a : a + together], (lambda seed, salt: np.ones(len(seed))) if self.random_cuts else draws, lambda x, y, group: y, self.random_cuts)
        return self


@dataclass
class Boosted(Ensemble):
    """Trees one after the other, each on what those before it leave, added at a small rate."""

    depth: int = 3
    rounds: int = 50
    rate: float = 0.1

    def fit(self, data: Binned) -> Boosted:
        self._start(data, True)
        self.scale = self.rate
        for k in range(self.rounds):
            new = [(g, Tree(self.depth), k) for g in range(len(self.base))]
            self.grow(data, new, lambda seed, salt: np.ones(len(seed)), lambda x, y, group: y - self.predicted(x, group))
            for g, tree, _ in new:
                self.trees[g].append(tree)
        return self


@dataclass
class Line:
    """A ridge on standardised values of some columns (of none: the mean), missing ones at the mean. All folds' models
    come from one pass, since a fold's products can be taken off those of all rows."""

    use: Sequence[int] = ()
    penalty: float = 1.0

    def fit(self, data: Binned) -> Line:
        k, folds, use = len(self.use), data.folds if data.folds > 1 else 0, list(self.use)

        def spread(f: pd.DataFrame) -> np.ndarray:
            v = grid(f["v"])[:, use]
            v = v[~np.isnan(f["y"].to_numpy(np.float64))]
            return np.concatenate(((~np.isnan(v)).sum(0), np.nansum(v, 0), np.nansum(v * v, 0)))

        n, s, q = summed(data.rows, ["v", "y"], spread, 3 * k).reshape(3, k) if k else np.zeros((3, 0))
        self.mean = s / np.maximum(n, 1)
        self.sd = np.sqrt(np.maximum(q / np.maximum(n, 1) - self.mean**2, 0))
        self.sd[self.sd <= 1e-9 * np.maximum(1, np.abs(self.mean))] = np.inf

        def add(f: pd.DataFrame) -> np.ndarray:
            y, fold = f["y"].to_numpy(np.float64), f["fold"].to_numpy()
            one = np.c_[np.ones(len(f)), self.scaled(grid(f["v"])), y]
            return np.stack([one[m].T @ one[m] for m in [*((fold == g) & ~np.isnan(y) for g in range(folds)), ~np.isnan(y)]]).ravel()

        each = summed(data.rows, ["v", "y", "fold"], add, (folds + 1) * (k + 2) ** 2).reshape(folds + 1, k + 2, k + 2)
        self.weights = [ridge(each[-1] - part, self.penalty) for part in each[:-1]] + [ridge(each[-1], self.penalty)]
        return self

    def scaled(self, v: np.ndarray) -> np.ndarray:
        return np.nan_to_num((v[:, list(self.use)] - self.mean) / self.sd)

    def outputs(self, x: np.ndarray, fold: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.scaled(v)
        each = np.stack([z @ w + b for w, b in self.weights], 1)
        return each[:, -1], each[np.arange(len(z)), fold] if len(self.weights) > 1 else each[:, -1]


def told(data: Binned, models: Sequence[Ensemble | Line]) -> DataFrame:
    """(key, actual, fold, whole, apart): each model's predictions of every row, and those of the folds' models that
    have not seen it."""
    key = data.key

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = grid(f["x"]).astype(np.int64)
                v = grid(f["v"])
                got = [m.outputs(x, f["fold"].to_numpy(), v) for m in models]
                yield f[[key, "fold"]].assign(actual=f["y"].where(f["y"].notna(), None), whole=list(np.stack([g[0] for g in got], 1)), apart=list(np.stack([g[1] for g in got], 1)))

    kind = data.rows.schema[key].dataType.simpleString()
    return data.rows.mapInPandas(run, f"`{key}` {kind}, fold int, actual double, whole array<double>, apart array<double>")


def voted(data: Binned, models: Sequence[Ensemble | Line]) -> DataFrame:
    """(key, actual, predicted): the mean of the models; rows that have a target get what was told without them."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / len(models)
    each = told(data, models)
    return each.select(data.key, "actual", F.when(F.col("actual").isNotNull(), mean("apart")).otherwise(mean("whole")).alias("predicted"))


def stacked(data: Binned, models: Sequence[Ensemble | Line], penalty: float = 1e-3) -> tuple[DataFrame, np.ndarray, float]:
    """(key, actual, predicted), weights and level: a ridge of the target on what each model told without the row."""
    each = stored(told(data, models), "told")
    k = len(models)

    def add(f: pd.DataFrame) -> np.ndarray:
        f = f[f["actual"].notna()]
        one = np.c_[np.ones(len(f)), np.array(f["apart"].tolist()).reshape(len(f), k), f["actual"].to_numpy(np.float64)]
        return (one.T @ one).ravel()

    w, b = ridge(summed(each, ["apart", "actual"], add, (k + 2) ** 2).reshape(k + 2, k + 2), penalty)
    total = lambda c: sum((F.get(c, F.lit(i)) * float(v) for i, v in enumerate(w)), F.lit(float(b)))
    return each.select(data.key, "actual", F.when(F.col("actual").isNotNull(), total("apart")).otherwise(total("whole")).alias("predicted")), w, b


def held_out_errors(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """n, rmse and weighted_rmse (by an SQL expression of ``actual``) of rows with a target."""
    e = F.col("actual") - F.col("predicted")
    w = F.expr(weight) if weight else F.lit(1.0)
    return rows.where("actual is not null").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.sum(w * e * e) / F.sum(w)).alias("weighted_rmse"))


def candidates(data: Binned, models: Sequence[tuple[str, Ensemble | Line]], weight: str) -> DataFrame:
    """(candidate, n, rmse, weighted_rmse, chosen): what each fitted model errs where it has not seen the row, from one
    pass; the least weighted error is chosen, of equal ones the first."""
    w = F.expr(weight)
    each = told(data, [m for _, m in models]).where("actual is not null").select("actual", F.posexplode("apart").alias("at", "p"), w.alias("w"))
    e = F.col("actual") - F.col("p")
    errors = each.groupBy("at").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.sum(F.col("w") * e * e) / F.sum("w")).alias("weighted_rmse"))
    best = errors.agg(F.min_by("at", F.struct("weighted_rmse", "at")).alias("best"))
    name = F.get(F.array(*[F.lit(n) for n, _ in models]), F.col("at"))
    return errors.join(F.broadcast(best)).select(name.alias("candidate"), "n", "rmse", "weighted_rmse", (F.col("at") == F.col("best")).alias("chosen"))


def top_columns(model: Ensemble, columns: Sequence[str], k: int) -> list[tuple[str, float]]:
    """The k most important columns, equal ones in their own order."""
    own = model.importances()
    return [(columns[i], float(own[i])) for i in np.lexsort((np.arange(len(own)), -own))[:k]]
