"""Gaussian processes over any number of rows, by inducing points.

With m points the rows enter only through the products of their kernel values with the points and with the target, which
one pass sums up for all length scales of a grid at once. Noise is then searched on the driver without another pass,
since the marginal likelihood follows from the same sums, and the amplitude has a closed form. Where the points are all
rows, this is the exact process.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.exact import finite
from gristmill.operators.latent import summed

#: Added to the points' own kernel so that equal points can be solved for.
JITTER = 1e-8


def kernel(x: np.ndarray, y: np.ndarray, scale: float, linear: float) -> np.ndarray:
    """Matern of order 5/2, and ``linear`` times (1 + x . y) on top."""
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0)) * (5**0.5 / scale)
    return (1 + d + d * d / 3) * np.exp(-d) + linear * (1 + x @ y.T)


@dataclass
class GaussianProcess:
    """``points``: the most inducing points, rows with the least hashes of the key (a bounded sample; all rows count in
    the fit). ``scales``, ``linear`` and ``noises`` are the grids that the marginal likelihood chooses from; the best
    length scale is refined once between its neighbours."""

    points: int = 64
    scales: Sequence[float] = (0.3, 1.0, 3.0, 10.0)
    linear: Sequence[float] = (0.0, 1.0)
    noises: Sequence[float] = tuple(10.0**e for e in np.arange(-4, 1.5, 0.5))

    def fit(self, df: DataFrame, key: str, predictors: Sequence[str], target: str) -> GaussianProcess:
        """Rows without the target are not used; a missing predictor stands at its mean."""
        self.key, self.predictors, k = key, list(predictors), len(predictors)
        own = df.select(F.col(f"`{key}`").alias("key"), *[finite(c).alias(f"x{i}") for i, c in enumerate(predictors)], finite(target).alias("y")).where("y is not null")
        names = [*(f"x{i}" for i in range(k)), "y"]
        s = own.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}{c}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.n = s["n"]
        self.mean, self.sd = (np.array([s[f"{n}{c}"] or e for c in names]) for n, e in (("m", 0.0), ("s", 1.0)))
        if self.n < 3:  # too few to tell anything
            return self
        own = own.select(*names)
        picked = df.where(finite(target).isNotNull()).select(*[finite(c).alias(f"x{i}") for i, c in enumerate(predictors)], F.col(f"`{key}`").alias("key")).orderBy(F.xxhash64("key"), "key").limit(self.points).toPandas()
        self.at = np.unique(self.scaled(picked), axis=0)
        best = self._best(own, [(v, c) for v in self.scales for c in self.linear])
        near = sorted(self.scales)
        i = near.index(best[1])
        between = [(best[1] * near[j]) ** 0.5 for j in (i - 1, i + 1) if 0 <= j < len(near)]
        best = max(best, self._best(own, [(v, best[2]) for v in between]), key=lambda b: b[0]) if between else best
        self.likelihood, self.scale, self.slope, self.noise, self.amplitude, self.weights, self.within, self.without = best
        return self

    def scaled(self, f: pd.DataFrame) -> np.ndarray:
        k = len(self.predictors)
        return np.nan_to_num((f[[f"x{i}" for i in range(k)]].to_numpy(np.float64) - self.mean[:k]) / self.sd[:k])

    def _best(self, own: DataFrame, kernels: list[tuple[float, float]]) -> tuple:
        """(likelihood, scale, linear, noise, amplitude, weights, inverses): the best of the kernels and noises."""
        m = len(self.at)

        def add(f: pd.DataFrame) -> np.ndarray:
            x, y, out = self.scaled(f), (f["y"].to_numpy(np.float64) - self.mean[-1]) / self.sd[-1], []
            for scale, linear in kernels:
                c = kernel(x, self.at, scale, linear)
                out += [(c.T @ c).ravel(), c.T @ y]
            return np.concatenate([*out, [y @ y]])

        names = [*(f"x{i}" for i in range(len(self.predictors))), "y"]
        s = summed(own, names, add, len(kernels) * (m * m + m) + 1)
        yy, n, best = s[-1], self.n, None
        for (scale, linear), part in zip(kernels, s[:-1].reshape(len(kernels), -1), strict=True):
            cross, b = part[: m * m].reshape(m, m), part[m * m :]
            inner = kernel(self.at, self.at, scale, linear)
            inner = inner + JITTER * np.trace(inner) / m * np.eye(m)
            for noise in self.noises:
                whole = noise * inner + cross
                w = np.linalg.solve(whole, b)
                amplitude = max((yy - b @ w) / noise / n, 1e-12)
                told = -0.5 * (n * np.log(2 * np.pi * amplitude) + n + np.linalg.slogdet(whole)[1] - np.linalg.slogdet(inner)[1] + (n - m) * np.log(noise))
                if best is None or told > best[0]:
                    best = (float(told), scale, linear, noise, amplitude, w, np.linalg.inv(inner), np.linalg.inv(whole))
        return best

    def told(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and variances (noise included) on the target's scale."""
        if self.n < 3:
            return np.full(len(x), self.mean[-1]), np.full(len(x), np.inf)
        c = kernel(x, self.at, self.scale, self.slope)
        own = np.ones(len(x)) + self.slope * (1 + (x * x).sum(1))
        quad = lambda q: np.einsum("ij,jk,ik->i", c, q, c)
        spread = np.maximum(own - quad(self.within), 0) + self.noise * quad(self.without) + self.noise
        return self.mean[-1] + self.sd[-1] * (c @ self.weights), self.sd[-1] ** 2 * self.amplitude * spread

    def predict(self, df: DataFrame) -> DataFrame:
        """(key, value, sigma2) of all rows."""
        key = self.key

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    mean, spread = self.told(self.scaled(f))
                    yield f[[key]].assign(value=mean, sigma2=spread)

        own = df.select(F.col(f"`{key}`").alias(key), *[finite(c).alias(f"x{i}") for i, c in enumerate(self.predictors)])
        return own.mapInPandas(run, f"`{key}` {own.schema[key].dataType.simpleString()}, value double, sigma2 double")
