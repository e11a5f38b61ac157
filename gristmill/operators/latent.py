"""Latent models of a wide matrix with gaps and a target: factors, traits and item response.

The matrix has any number of rows and the columns of a schema. What belongs to a column is held by the driver and goes
to the tasks with the code; what belongs to a row follows from its own cells and the columns' parameters, so that it is
computed where the row is and never kept. Each round is one pass: every task adds up the normal equations of all
columns over its rows, Spark sums them up by place, and the small systems are solved on the driver. No group of rows
is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.exact import finite, medians
from gristmill.tables import discard, stored


def summed(rows: DataFrame, columns: Sequence[str], add: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what ``add`` gives for a batch of them: one array a task, summed by place."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for f in frames:
            if len(f):
                total += add(f)
        yield pd.DataFrame({"sums": [total]})

    return added(rows.select(*columns).mapInPandas(run, "sums array<double>"), size)


def added(each: DataFrame, size: int) -> np.ndarray:
    """The tasks' arrays ``sums``, summed by place."""
    out = np.zeros(size)
    for at, v in each.select(F.posexplode("sums").alias("at", "v")).where("v != 0").groupBy("at").agg(F.sum("v")).collect():
        out[at] = v
    return out


def array_sums(rows: DataFrame, columns: Sequence[str], add: Callable[..., np.ndarray], size: int) -> np.ndarray:
    """``summed`` for columns of numbers and of arrays of one length: ``add`` gets them as numpy arrays, straight from
    Arrow, without an object a row."""

    def numbers(v: pa.Array) -> np.ndarray:
        return np.array(v.flatten(), np.float64).reshape(len(v), -1) if pa.types.is_list(v.type) else np.array(v.to_numpy(zero_copy_only=False), np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += add(*[numbers(v) for v in b.columns])
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

    return added(rows.select(*columns).mapInArrow(run, "sums array<double>"), size)


def totals(rows: DataFrame, add: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """``summed`` over rows (x, y), as arrays."""
    return array_sums(rows, ["x", "y"], add, size)


def arrays(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """x (a row each, nan where a cell is missing) and y (nan where there is no target)."""
    return np.stack(f["x"].to_numpy()).astype(np.float64, copy=False), f["y"].to_numpy(np.float64)


@dataclass
class Matrix:
    """Standardised rows (key, x, y) of a frame, the target too, stored for as many passes as a fit takes."""

    rows: DataFrame
    key: str
    columns: list[str]
    mean: np.ndarray
    sd: np.ndarray
    middle: np.ndarray  # medians on the standardised scale, where a column has values
    level: float = 0.0  # of the target
    width: float = 1.0

    @classmethod
    def of(cls, df: DataFrame, key: str, columns: Sequence[str], target: str | None = None) -> Matrix:
        """Values that are no finite numbers are missing; a column without spread is only centred."""
        own = stored(df.select(F.col(f"`{key}`").alias(key), *[finite(c).alias(f"c{i}") for i, c in enumerate(columns)], (finite(target) if target else F.lit(None).cast("double")).alias("y")), "matrix-raw")
        names = [f"c{i}" for i in range(len(columns))]
        s = own.agg(*[f(c).alias(f"{n}{c}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        mean = np.array([s[f"m{c}"] or 0.0 for c in names])
        sd = np.array([s[f"s{c}"] if (s[f"s{c}"] or 0) >= 1e-8 else 1.0 for c in names])
        t = own.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
        level, width = t["m"] or 0.0, t["s"] if (t["s"] or 0) >= 1e-8 else 1.0
        at = medians(own, names)
        middle = np.array([0.0 if at[c] is None else (at[c] - m) / d for c, m, d in zip(names, mean, sd, strict=True)])
        z = [F.coalesce((F.col(c) - F.lit(float(m))) / F.lit(float(d)), F.lit(float("nan"))) for c, m, d in zip(names, mean, sd, strict=True)]
        rows = stored(own.select(key, F.array(*z).alias("x"), F.coalesce((F.col("y") - F.lit(float(level))) / F.lit(float(width)), F.lit(float("nan"))).alias("y")), "matrix")
        discard(own)
        return cls(rows, key, list(columns), mean, sd, middle, level, width)

    def placed(self, df: DataFrame) -> Matrix:
        """Other rows on this matrix's scale, without their targets."""
        z = [F.coalesce((finite(c) - F.lit(float(m))) / F.lit(float(d)), F.lit(float("nan"))) for c, m, d in zip(self.columns, self.mean, self.sd, strict=True)]
        rows = df.select(F.col(f"`{self.key}`").alias(self.key), F.array(*z).alias("x"), F.lit(float("nan")).alias("y"))
        return Matrix(rows, self.key, self.columns, self.mean, self.sd, self.middle, self.level, self.width)

    def drop(self) -> None:
        discard(self.rows)

    def told(self, tell: Callable[[np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
        """(key, ...) by what ``tell`` gives for a batch. The stored rows must outlive the frame."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    yield f[[key]].assign(**tell(*arrays(f)))

        key = self.key
        return self.rows.mapInPandas(run, f"`{key}` {self.rows.schema[key].dataType.simpleString()}, {schema}")


def outer(z: np.ndarray) -> np.ndarray:
    """A row's products with itself, flattened."""
    return (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)


def start(m: Matrix, rank: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Leading directions of the matrix with gaps at the medians, each times the root of its singular value, and the
    ridge of the target on the rows' places along them."""
    p, middle = len(m.columns), m.middle

    def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        full = np.where(np.isnan(x), middle, x)
        own = np.c_[np.ones((~np.isnan(y)).sum()), full[~np.isnan(y)], y[~np.isnan(y)]]
        return np.concatenate(((full.T @ full).ravel(), (own.T @ own).ravel()))

    s = totals(m.rows, add, p * p + (p + 2) ** 2)
    values, vectors = np.linalg.eigh(s[: p * p].reshape(p, p))
    values, vectors = np.maximum(values[::-1][:rank], 1e-12), vectors[:, ::-1][:, :rank]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    root = values**0.25  # the root of the singular value
    turn = vectors / root
    q = s[p * p :].reshape(p + 2, p + 2)
    whole = np.zeros((turn.shape[1] + 2, p + 2))
    whole[0, 0] = whole[-1, -1] = 1.0
    whole[1:-1, 1:-1] = turn.T
    w, b = ridge(whole @ q @ whole.T, 0.01)
    return vectors * root, w, b


def ridge(q: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and level from the products of (1, z, y) with themselves; the level is free of the penalty."""
    n, k = q[0, 0], len(q) - 2
    if n == 0:
        return np.zeros(k), 0.0
    mean = q[0] / n
    spread = q - n * np.outer(mean, mean)
    w = np.linalg.solve(spread[1:-1, 1:-1] + penalty * np.eye(k), spread[1:-1, -1])
    return w, float(mean[-1] - mean[1:-1] @ w)


def evidence_ridge(q: np.ndarray, rounds: int = 300, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """The same with noise and weight precisions by evidence maximisation (flat priors of 1e-6)."""
    n, k = q[0, 0], len(q) - 2
    if n == 0:
        return np.zeros(k), 0.0
    mean = q[0] / n
    spread = q - n * np.outer(mean, mean)
    values, vectors = np.linalg.eigh(spread[1:-1, 1:-1])
    values, cross, yy = np.maximum(values, 0), vectors.T @ spread[1:-1, -1], max(spread[-1, -1], 0.0)
    alpha, weight, w = 1 / (yy / n + 1e-12), 1.0, np.zeros(k)
    for _ in range(rounds):
        before, turned = w, cross / (values + weight / alpha)
        w = vectors @ turned
        left = max(yy - 2 * turned @ cross + (values * turned) @ turned, 0.0)
        used = (alpha * values / (weight + alpha * values)).sum()
        weight, alpha = (used + 2e-6) / (w @ w + 2e-6), (n - used + 2e-6) / (left + 2e-6)
        if np.abs(w - before).sum() < tolerance:
            break
    w = vectors @ (cross / (values + weight / alpha))
    return w, float(mean[-1] - mean[1:-1] @ w)


@dataclass
class Factors:
    """x ~ w z and y ~ t z + b, by alternating least squares of

        recall * |x - w z|^2 over cells + supervise * |y - t z - b|^2 over labelled rows + shrink * (|z|^2 + |w|^2 + |t|^2)

    Each step minimises this over its own part, so that it never rises."""

    rank: int = 6
    recall: float = 1.0
    supervise: float = 5.0
    shrink: float = 0.01
    rounds: int = 100
    tolerance: float = 1e-4
    losses: list[float] = field(default_factory=list)

    def places(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rows' factors under the columns' weights."""
        seen, k = ~np.isnan(x), self.w.shape[1]
        precision = self.recall * (seen @ outer(self.w)).reshape(-1, k, k) + self.shrink * np.eye(k)
        pull = self.recall * np.where(seen, x, 0.0) @ self.w
        has = ~np.isnan(y)
        precision[has] += self.supervise * np.outer(self.t, self.t)
        pull[has] += self.supervise * (y[has] - self.b)[:, None] * self.t
        return np.linalg.solve(precision, pull[:, :, None])[:, :, 0]

    def fit(self, m: Matrix) -> Factors:
        p = len(m.columns)
        self.rank = k = min(self.rank, p)
        self.w, self.t, self.b = start(m, k)

        def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z, seen, has = self.places(x, y), ~np.isnan(x), ~np.isnan(y)
            filled = np.where(seen, x, 0.0)
            own = np.c_[np.ones(has.sum()), z[has], y[has]]
            loss = self.recall * (np.where(seen, x - z @ self.w.T, 0.0) ** 2).sum() + self.supervise * ((y[has] - z[has] @ self.t - self.b) ** 2).sum() + self.shrink * (z**2).sum()
            return np.concatenate(((seen.T @ outer(z)).ravel(), (filled.T @ z).ravel(), (own.T @ own).ravel(), [loss]))

        while True:
            s = totals(m.rows, add, p * k * k + p * k + (k + 2) ** 2 + 1)
            a, c, q = np.split(s[:-1], [p * k * k, p * k * k + p * k])
            self.losses.append(float(s[-1] + self.shrink * ((self.w**2).sum() + (self.t**2).sum())))
            if len(self.losses) >= self.rounds or len(self.losses) > 1 and abs(self.losses[-2] - self.losses[-1]) < self.tolerance:
                return self
            self.w = np.linalg.solve(self.recall * a.reshape(p, k, k) + self.shrink * np.eye(k), self.recall * c.reshape(p, k, 1))[:, :, 0]
            self.t, self.b = ridge(q.reshape(k + 2, k + 2), self.shrink / self.supervise)

    def predict(self, m: Matrix) -> DataFrame:
        """(key, predicted, factors) of all rows; a labelled row's factors know its target."""

        level, width = m.level, m.width

        def tell(x: np.ndarray, y: np.ndarray) -> dict:
            z = self.places(x, y)
            return {"predicted": level + width * (z @ self.t + self.b), "factors": list(z)}

        return m.told(tell, "predicted double, factors array<double>")


def prefix_families(columns: Sequence[str]) -> list[list[int]]:
    """Columns with the same name before the first underscore."""
    out: dict[str, list[int]] = {}
    for i, c in enumerate(columns):
        out.setdefault(c.split("_")[0], []).append(i)
    return list(out.values())


@dataclass
class Traits:
    """x_j ~ N(l_j z, v_j), y ~ N(t z + b, s), z ~ N(0, 1), and loadings drawn towards the mean of their family, by
    expectation and maximisation: rows' posteriors in the pass, columns' parameters from its sums."""

    rank: int = 6
    rounds: int = 50
    strength: float = 1.0
    tolerance: float = 1e-4
    likelihoods: list[float] = field(default_factory=list)

    def posterior(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and covariances of the rows' traits."""
        seen, k, has = ~np.isnan(x), self.loadings.shape[1], ~np.isnan(y)
        precise = 1 / np.maximum(self.noise, 1e-8)
        precision = (seen @ (outer(self.loadings) * precise[:, None])).reshape(-1, k, k) + np.eye(k)
        pull = (np.where(seen, x, 0.0) * precise) @ self.loadings
        precision[has] += np.outer(self.t, self.t) / max(self.spread, 1e-8)
        pull[has] += (y[has] - self.b)[:, None] * self.t / max(self.spread, 1e-8)
        cov = np.linalg.inv(precision)
        cov = (cov + cov.transpose(0, 2, 1)) / 2
        return np.einsum("nij,nj->ni", cov, pull), cov

    def fit(self, m: Matrix, families: Sequence[Sequence[int]] | None = None) -> Traits:
        """``families``: groups of columns' numbers (all in one if none are given)."""
        p, k = len(m.columns), self.rank
        groups = [list(g) for g in families or [range(p)]]
        self.loadings, self.noise, self.t, self.b, self.spread = np.zeros((p, k)), np.full(p, 0.5), np.zeros(k), 0.0, 1.0
        w, t, self.b = start(m, min(k, p))
        self.loadings[:, : w.shape[1]], self.t[: len(t)] = w, t
        y = m.rows.where(~F.isnan("y")).agg(F.var_pop("y")).first()[0]
        self.spread = max(y or 0.0, 1e-4)

        def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            mean, cov = self.posterior(x, y)
            seen, has, n = ~np.isnan(x), ~np.isnan(y), len(x)
            filled, own = np.where(seen, x, 0.0), np.c_[np.ones(has.sum()), mean[has], y[has]]
            both = outer(mean) + cov.reshape(n, -1)
            return np.concatenate(((seen.T @ both).ravel(), (filled.T @ mean).ravel(), seen.sum(0), (filled**2).sum(0), (own.T @ own).ravel(), cov[has].sum(0).ravel()))

        while len(self.likelihoods) < self.rounds:
            s = totals(m.rows, add, p * k * k + p * k + 2 * p + (k + 2) ** 2 + k * k)
            a, c, n, xx, q, cov = np.split(s, np.cumsum([p * k * k, p * k, p, p, (k + 2) ** 2]))
            a, c, q, cov = a.reshape(p, k, k), c.reshape(p, k), q.reshape(k + 2, k + 2), cov.reshape(k, k)
            middle = np.zeros((p, k))
            for g in groups:
                middle[g] = self.loadings[g].mean(0)
            new = np.linalg.solve(a + self.strength * np.eye(k), (c + self.strength * middle)[:, :, None])[:, :, 0]
            self.loadings = np.where(n[:, None] > 0, new, self.loadings)
            left = xx - 2 * (self.loadings * c).sum(1) + np.einsum("pi,pij,pj->p", self.loadings, a, self.loadings)
            self.noise = np.where(n > 1, np.maximum(left / np.maximum(n, 1), 1e-4), self.noise)
            self.t, self.b = evidence_ridge(q)
            e = np.r_[-self.b, -self.t, 1.0]
            off = max(e @ q @ e, 0.0) + self.t @ cov @ self.t
            self.spread = max(off / q[0, 0], 1e-4) if q[0, 0] else self.spread
            told = -0.5 * ((n * np.log(self.noise) + left / self.noise)[n > 0].sum() + q[0, 0] * np.log(self.spread) + off / self.spread)
            self.likelihoods.append(float(told))
            if len(self.likelihoods) > 1 and abs(self.likelihoods[-1] - self.likelihoods[-2]) < self.tolerance:
                break
        return self

    def predict(self, m: Matrix) -> DataFrame:
        """(key, predicted, sigma, traits, trait_sigmas) of all rows."""

        level, width = m.level, m.width

        def tell(x: np.ndarray, y: np.ndarray) -> dict:
            mean, cov = self.posterior(x, y)
            sd = width * np.sqrt(np.einsum("i,nij,j->n", self.t, cov, self.t) + self.spread)
            return {"predicted": level + width * (mean @ self.t + self.b), "sigma": sd, "traits": list(mean), "trait_sigmas": list(np.sqrt(np.einsum("nii->ni", cov)))}

        return m.told(tell, "predicted double, sigma double, traits array<double>, trait_sigmas array<double>")


def cross_validated(df: DataFrame, key: str, columns: Sequence[str], target: str, make: Callable[[], Factors | Traits], folds: int = 5, inductive: bool = False) -> DataFrame:
    """(key, fold, actual, predicted) of the rows with a target, each by a model that has not seen it.

    Transductive: the fold's rows are there, without their targets. ``inductive``: they are not there at all, and are
    placed afterwards by their own cells, on the scale of the others. Folds by hash of the key."""
    fold = F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")
    out = None
    for f in range(folds):
        apart = fold == f
        seen = df.where(~apart) if inductive else df.withColumn(target, F.when(~apart, F.col(target)))
        m = Matrix.of(seen, key, columns, target)
        model = make().fit(m)
        asked = m.placed(df.where(apart)) if inductive else m
        told_ = model.predict(asked).select(key, "predicted")
        part = df.where(apart & F.col(target).isNotNull()).select(F.col(key), F.lit(f).alias("fold"), F.col(target).cast("double").alias("actual")).join(told_, key)
        part = stored(part, "latent-fold")
        m.drop()
        out = part if out is None else out.unionByName(part)
    return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class ItemResponse:
    """Scores between 0 and 1 as logistic(a_j . ability_i - b_j): abilities and items in turn, by damped Gauss-Newton
    steps on 0.5 * |residuals|^2 + shrink * (|abilities|^2 + |a|^2). A step on the items that raises it is taken back
    and damped more."""

    rank: int = 1
    shrink: float = 0.01
    rounds: int = 60
    steps: int = 25
    tolerance: float = 1e-7
    losses: list[float] = field(default_factory=list)

    def parts(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Residuals and slopes of the cells (0 where missing), and each row's part of the loss."""
        p = logistic(z @ self.a.T - self.b)
        r = np.where(np.isnan(x), 0.0, p - x)
        return r, np.where(np.isnan(x), 0.0, p * (1 - p)), 0.5 * (r * r).sum(1) + self.shrink * (z * z).sum(1)

    def abilities(self, x: np.ndarray) -> np.ndarray:
        """The rows' best places under the items; every row has its own damping."""
        k = self.a.shape[1]
        z, damp = np.zeros((len(x), k)), np.full(len(x), 1e-3)
        r, s, loss = self.parts(x, z)
        for _ in range(self.steps):
            grad = (r * s) @ self.a + 2 * self.shrink * z
            bend = ((s * s) @ outer(self.a)).reshape(-1, k, k) + (2 * self.shrink + damp)[:, None, None] * np.eye(k)
            new = z - np.linalg.solve(bend, grad[:, :, None])[:, :, 0]
            nr, ns, nl = self.parts(x, new)
            good = nl <= loss
            z, r, s, loss = np.where(good[:, None], new, z), np.where(good[:, None], nr, r), np.where(good[:, None], ns, s), np.where(good, nl, loss)
            damp = np.where(good, damp / 3, damp * 10)
        return z

    def fit(self, rows: DataFrame, p: int) -> ItemResponse:
        """``rows``: x (values between 0 and 1, nan where missing) and y (not looked at)."""
        k = self.rank
        means = totals(rows, lambda x, y: np.r_[np.nansum(x, 0), (~np.isnan(x)).sum(0)], 2 * p)
        share = np.clip(np.where(means[p:] > 0, means[:p] / np.maximum(means[p:], 1), 0.5), 0.01, 0.99)
        self.b = -np.log(share / (1 - share))
        self.a = 1.0 + 0.1 * np.cos(1.0 + np.arange(p)[:, None] * (1 + np.arange(k)))  # apart, by rule
        damp, before = 1e-3, None

        def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = self.abilities(x)
            r, s, loss = self.parts(x, z)
            one = np.c_[z, -np.ones(len(z))]
            return np.concatenate((((s * s).T @ outer(one)).ravel(), ((r * s).T @ one).ravel(), [loss.sum()]))

        for _ in range(self.rounds):
            sums = totals(rows, add, p * (k + 1) ** 2 + p * (k + 1) + 1)
            loss = float(sums[-1] + self.shrink * (self.a**2).sum())
            if before is not None and loss > self.losses[-1]:
                (self.a, self.b, sums), damp = before, damp * 10
            else:
                self.losses.append(loss)
                if len(self.losses) > 1 and self.losses[-2] - loss < self.tolerance * max(1.0, loss):
                    return self
                before, damp = (self.a, self.b, sums), max(damp / 3, 1e-6)
            bend, grad, _ = np.split(sums, [p * (k + 1) ** 2, p * (k + 1) ** 2 + p * (k + 1)])
            pull = 2 * self.shrink * np.c_[self.a, np.zeros(p)]
            bend = bend.reshape(p, k + 1, k + 1) + damp * np.eye(k + 1) + 2 * self.shrink * np.diag(np.r_[np.ones(k), 0.0])
            step = np.linalg.solve(bend, (grad.reshape(p, k + 1) + pull)[:, :, None])[:, :, 0]
            self.a, self.b = self.a - step[:, :k], self.b - step[:, k]
        self.a, self.b = before[:2]  # the last step has not been tried
        return self


def unit_range(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, x, y): columns scaled from their least and greatest values to 0 and 1, nan where missing."""
    v = [F.col(f"`{c}`").cast("double") for c in columns]
    s = df.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(v) for n, f in (("a", F.min), ("b", F.max))]).first()
    scaled = []
    for i, x in enumerate(v):
        a, b = (s[f"a{i}"] or 0.0), (s[f"b{i}"] or 0.0)
        scaled.append(F.coalesce((x - F.lit(a)) / F.lit(b - a if b - a >= 1e-12 else 1.0), F.lit(float("nan"))))
    return df.select(F.col(f"`{key}`").alias(key), F.array(*scaled).alias("x"), F.lit(float("nan")).alias("y"))


def ability_features(rows: DataFrame, key: str, model: ItemResponse) -> DataFrame:
    """(key, features): abilities, their squares and products, each standardised over all rows (scales from one
    aggregation)."""
    k = model.rank
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                z = model.abilities(arrays(f)[0])
                yield f[[key]].assign(features=list(np.c_[z, np.stack([z[:, i] * z[:, j] for i, j in pairs], 1)]))

    kind = rows.schema[key].dataType.simpleString()
    own = rows.mapInPandas(run, f"`{key}` {kind}, features array<double>")
    each = own.select(F.posexplode("features").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    scale = {r["at"]: (r["m"], r["s"] or 1.0) for r in each}
    n = k + len(pairs)
    return own.select(key, F.array(*[(F.get("features", F.lit(i)) - scale.get(i, (0.0, 1.0))[0]) / scale.get(i, (0.0, 1.0))[1] for i in range(n)]).alias("features"))
