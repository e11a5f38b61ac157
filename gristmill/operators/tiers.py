"""Imputation in tiers: easy columns first, sure cells first, what was filled serving as predictors of the rest.

Models are fitted once, on observed cells. A round goes through the tiers in order; all columns of a tier are told from
one snapshot of the table, and a cell is filled if it is as sure as the column's tolerance asks. A missing predictor
stands at its mean and adds to the uncertainty what it would have explained, so that cells grow surer as their row
fills up. Each step is a written table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.correlate import candidates, pairs
from gristmill.operators.exact import finite, medians, quantiles
from gristmill.operators.impute import LEAST, Linear, moments, square, together
from gristmill.tables import discard, stored


def difficulties(gaps: dict[str, float], strongest: dict[str, float]) -> dict[str, float]:
    """Share of gaps times what the best proxy leaves unexplained."""
    return {c: gaps[c] * (1 - strongest.get(c, 0.0)) for c in gaps}


def in_tiers(difficulty: dict[str, float], shares: Sequence[float]) -> dict[str, int]:
    """Tier of each column with gaps: how many of the percentiles at these shares lie below its difficulty."""
    own = sorted(v for v in difficulty.values())
    cuts = [float(np.quantile(own, q)) for q in shares] if own else []
    return {c: sum(v > cut for cut in cuts) for c, v in difficulty.items()}


def told(model: Linear) -> tuple[Column, Column]:
    """Value and standard deviation of a cell, whichever of the predictors its row has."""
    value, extra = F.lit(float(model.level)), F.lit(0.0)
    z = []
    for c, m, s, b in zip(model.predictors, model.mean, model.sd, model.beta, strict=True):
        z.append(F.coalesce((F.col(c) - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0)))
        value = value + z[-1] * F.lit(float(b))
        extra = extra + F.when(F.col(c).isNull(), float(b * b)).otherwise(0.0)
    lever = sum((z[i] * z[j] * F.lit(float(model.inverse[i, j])) for i in range(len(z)) for j in range(len(z))), F.lit(float(1 / model.n)))
    return value, F.sqrt(F.lit(float(model.sigma2)) * (1 + lever) + extra)


@dataclass
class Tiers:
    """``proxies``: predictors of a column; ``percentile`` and ``multiplier``: the tolerance, from the deviations of
    rows that have the value; ``relax``: by how much a tolerance grows after a step in which none of its column's
    cells was sure enough (the surest one is then filled alone)."""

    proxies: int = 3
    shares: Sequence[float] = (1 / 3, 2 / 3)
    percentile: float = 0.9
    multiplier: float = 1.2
    relax: float = 1.3
    rounds: int = 14
    log: list[tuple[int, int, str, int]] = field(default_factory=list)  # round, tier, column, cells filled

    def fit(self, df: DataFrame, columns: Sequence[str]) -> None:
        n, *there = df.agg(F.count("*"), *[F.count(c) for c in columns]).first()
        pair = stored(pairs(df, columns), "tier-pairs")
        chosen: dict[str, list[str]] = {c: [] for c in columns}
        for r in candidates(pair, LEAST, self.proxies).collect():
            chosen[r["target"]].append(r["proxy"])
        strongest: dict[str, float] = {}
        for r in pair.collect():
            for c in (r["a"], r["b"]):
                strongest[c] = max(strongest.get(c, 0.0), abs(r["r"] or 0.0))
        discard(pair)
        gaps = {c: 1 - v / n for c, v in zip(columns, there, strict=True) if n and 0 < v < n}
        self.tiers = in_tiers(difficulties(gaps, strongest), self.shares)
        asked = {c: sorted(chosen[c]) for c in self.tiers if chosen[c]}
        sums = df.agg(*[moments(df, c, p).alias(c) for c, p in asked.items()]).first() if asked else {}
        self.models = {}
        for c, p in asked.items():
            m = square(sums[c])
            if m[0, 0] >= max(LEAST, 5 * (len(p) + 1)):
                self.models[c] = Linear(p, m)
        sure = df.select(*[F.when(together([*m.predictors, c]), told(m)[1]).alias(c) for c, m in self.models.items()]) if self.models else None
        at = quantiles(sure, {c: [self.percentile] for c in self.models}) if self.models else {}
        self.tolerances = {c: at[c][0] * self.multiplier for c in self.models}

    def filled(self, df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
        """(key, column, value, sigma, round) of all cells: round 0 was there; a cell that no model could tell has the
        column's median, no sigma and no round. Keys are unique; a column without values stays null."""
        own = df.select(F.col(key).alias(key), *[finite(c).alias(c) for c in columns])
        marks = {c: (f"__s_{c}", f"__r_{c}") for c in columns}
        start = [F.when(F.col(c).isNotNull(), 0.0).alias(marks[c][0]) for c in columns] + [F.when(F.col(c).isNotNull(), 0).alias(marks[c][1]) for c in columns]
        now = stored(own.select("*", *start), "tier-table")
        self.fit(now, columns)
        for round_ in range(1, self.rounds + 1):
            wrote = 0
            for tier in sorted(set(self.tiers.values())):
                step = [c for c in columns if self.tiers.get(c) == tier and c in self.models]
                tells = {c: told(self.models[c]) for c in step}
                if not step:
                    continue
                open_ = {c: F.col(c).isNull() for c in step}
                facts = [f for c in step for f in (
                    F.count_if(open_[c]).alias(f"n_{c}"), F.count_if(open_[c] & (tells[c][1] <= self.tolerances[c])).alias(f"p_{c}"),
                    F.min(F.when(open_[c], F.struct(tells[c][1].alias("s"), F.col(key).alias("k")))).alias(f"b_{c}"),
                )]
                seen = now.agg(*facts).first()
                put: dict[str, Column] = {}
                for c in step:
                    if not seen[f"n_{c}"]:
                        continue
                    value, sigma = tells[c]
                    passed = seen[f"p_{c}"]
                    take = open_[c] & ((sigma <= self.tolerances[c]) if passed else (F.col(key) == F.lit(seen[f"b_{c}"]["k"])))
                    put |= {c: F.when(take, value).otherwise(F.col(c)).alias(c), marks[c][0]: F.when(take, sigma).otherwise(F.col(marks[c][0])).alias(marks[c][0]), marks[c][1]: F.when(take, round_).otherwise(F.col(marks[c][1])).alias(marks[c][1])}
                    if not passed:
                        self.tolerances[c] *= self.relax
                    self.log.append((round_, tier, c, passed or 1))
                    wrote += passed or 1
                if put:
                    before, now = now, stored(now.select(*[put.get(c, F.col(c)) for c in now.columns]), "tier-table")
                    discard(before)
            if not wrote:
                break
        middle = medians(own, columns)
        cells = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(middle[c]).cast("double")).alias("value"), F.col(marks[c][0]).alias("sigma"), F.col(marks[c][1]).alias("round")) for c in columns]
        return now.select(key, F.inline(F.array(*cells)))
