"""Poisson bootstrap: all draws as weighted sums of one pass, by numbers that any engine computes alike."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.latent import summed

PRIME = 2147483647
#: Chances of a Poisson count of mean 1 being at most 0, 1, 2, 3, 4; beyond that it counts as 5.
CUTS = (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015)
#: Rows whose counts of all draws are held at once.
CHUNK = 128


def counts(keys: np.ndarray, draws: int) -> np.ndarray:
    """How often each key's row is in each draw: key and draw mixed by squaring modulo PRIME."""
    x = np.fmod(np.fmod(keys.astype(np.int64), PRIME)[:, None] * 48271 + np.arange(draws) * 69621 + 12345, PRIME)
    x = np.fmod(x * x + 7 * x + 11, PRIME)
    u = np.fmod(x * x + 13 * x + 17, PRIME) / float(PRIME)
    return sum((u >= c).astype(np.float64) for c in CUTS)


def resampled(df: DataFrame, key: str, values: Sequence[Column], draws: int = 2000) -> np.ndarray:
    """For each value (null counts as 0) its weighted sum in each draw. ``key``: a number that names the row."""
    names = [f"v{i}" for i in range(len(values))]
    own = df.select(F.col(key).cast("long").alias("key"), *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in zip(names, values, strict=True)]).where("key is not null")

    def add(f: pd.DataFrame) -> np.ndarray:
        out, keys, v = np.zeros((len(names), draws)), f["key"].to_numpy(), f[names].to_numpy(np.float64)
        for a in range(0, len(f), CHUNK):
            out += v[a : a + CHUNK].T @ counts(keys[a : a + CHUNK], draws)
        return out.ravel()

    return summed(own, ["key", *names], add, len(names) * draws).reshape(len(names), draws)
