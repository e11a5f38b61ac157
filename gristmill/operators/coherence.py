"""Imputed cells drawn towards what the whole matrix says of them, by fixed shapes, by row or by a learned gate.

All of it comes from aggregations over the completed matrix: means and deviations, the products that give the leading
directions, what those leave of observed cells, and, for the learned gate, the products of a ridge whose rows are the
observed cells themselves. Cells are then drawn by expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.impute import square
from gristmill.operators.latent import ridge
from gristmill.tables import stored

#: Weight of the approximation by t, the cell's variance over its column's, and the strength s.
SHAPES = {
    "linear": lambda t, s: t / (t + s),
    "squared": lambda t, s: t * t / (t * t + s),
    "power3": lambda t, s: t * t * t / (t * t * t + s),
    "exp": lambda t, s: 1 - F.exp(-t / s),
    "step": lambda t, s: F.when(t > s, 1.0).otherwise(0.0),
}
GATES = ("fixed", "row_adaptive", "learned")
#: Cells that a learned gate needs; with fewer the fixed shape holds.
LEAST_CELLS = 20


def drawn(cells: DataFrame, key: str, columns: Sequence[str], rank: int, strength: float = 8.0, shape: str = "linear", gate: str = "fixed") -> DataFrame:
    """(key, column, value, sigma2, origin, weight) from cells (key, column, value, sigma2, origin).

    Observed cells stay, with weight 0. The rest become (1 - w) * value + w * approximation, their variance (1 - w)^2
    of its own plus w^2 of the approximation's. ``row_adaptive``: linear, the strength scaled by the square of the
    row's share of observed cells. ``learned``: w by a ridge on five features, fitted to observed cells."""
    if shape not in SHAPES or gate not in GATES:
        raise ValueError(f"shape is one of {', '.join(SHAPES)}, gate one of {', '.join(GATES)}")
    pick = lambda c: F.first(c).alias(c)
    wide = cells.groupBy(key).pivot("column", list(columns)).agg(pick("value"), pick("sigma2"), pick("origin"))
    named = [F.col(key)] + [F.col(f"`{c}_{x}`").alias(f"{x}{i}") for i, c in enumerate(columns) for x in ("value", "sigma2", "origin")]
    wide = stored(wide.select(*named), "coherent-wide")
    k = range(len(columns))
    value, sigma2 = [F.col(f"value{i}") for i in k], [F.col(f"sigma2{i}") for i in k]
    there = [F.col(f"origin{i}") == "observed" for i in k]
    s = wide.agg(*[f.alias(f"{n}{i}") for i in k for n, f in (("m", F.avg(value[i])), ("s", F.stddev(F.when(there[i], value[i]))), ("c", F.avg(there[i].cast("int"))), ("t", F.avg(F.when(~there[i], sigma2[i]))))]).first()
    mean, sd = [s[f"m{i}"] or 0.0 for i in k], [s[f"s{i}"] if (s[f"s{i}"] or 0) > 1e-10 else 1.0 for i in k]
    z = [F.coalesce((value[i] - F.lit(mean[i])) / F.lit(sd[i]), F.lit(0.0)) for i in k]
    gram = wide.agg(F.array(*[F.coalesce(F.sum(z[i] * z[j]), F.lit(0.0)) for i in k for j in range(i + 1)])).first()[0]
    basis = np.linalg.eigh(square(gram))[1][:, ::-1][:, :rank]
    project = basis @ basis.T
    smooth = [sum((z[j] * F.lit(float(project[i, j])) for j in k), F.lit(0.0)) * F.lit(sd[i]) + F.lit(mean[i]) for i in k]
    off = wide.agg(*[F.avg(F.when(there[i], (value[i] - smooth[i]) * (value[i] - smooth[i]))).alias(f"e{i}") for i in k]).first()
    rest = [off[f"e{i}"] if off[f"e{i}"] is not None else sd[i] ** 2 for i in k]
    row = sum((t.cast("int") for t in there), F.lit(0)) / len(columns)

    def features(i: int, t: Column) -> list[Column]:
        return [t, row, F.lit(float(s[f"c{i}"] or 0.0)), F.lit(rest[i] / sd[i] ** 2), F.abs(value[i] - smooth[i]) / F.lit(sd[i])]

    taught = None
    if gate == "learned":
        sums = []
        for i in k:
            if s[f"c{i}"] is None or not 0 < s[f"c{i}"] < 1:
                continue
            own = float(s[f"t{i}"] or sd[i] ** 2)
            aim = F.lit(own) / (own + (value[i] - smooth[i]) * (value[i] - smooth[i]) + 1e-10)
            terms = [F.lit(1.0), *features(i, F.lit(own / sd[i] ** 2)), aim]
            sums.append([F.coalesce(F.sum(F.when(there[i], terms[a] * terms[b])), F.lit(0.0)) for a in range(7) for b in range(a + 1)])
        if sums:
            q = square(wide.agg(F.array(*[sum(part, F.lit(0.0)) for part in zip(*sums, strict=True)])).first()[0])
            taught = ridge(q, 1.0) if q[0, 0] >= LEAST_CELLS else None
    out = []
    for i, c in zip(k, columns, strict=True):
        t = sigma2[i] / F.lit(sd[i] ** 2)
        if taught is not None:
            w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum((f * F.lit(float(b)) for f, b in zip(features(i, t), taught[0], strict=True)), F.lit(taught[1]))))
        elif gate == "row_adaptive":
            w = F.coalesce(F.try_divide(t, t + F.lit(strength) * row * row), F.lit(0.0))
        else:
            w = SHAPES[shape](t, F.lit(strength))
        w = F.when(there[i], 0.0).otherwise(F.coalesce(w, F.lit(0.0)))
        new = F.when(there[i], value[i]).otherwise((1 - w) * value[i] + w * smooth[i])
        out.append(F.struct(F.lit(c).alias("column"), new.alias("value"), ((1 - w) * (1 - w) * sigma2[i] + w * w * F.lit(rest[i])).alias("sigma2"), F.col(f"origin{i}").alias("origin"), w.alias("weight")))
    return wide.select(key, F.inline(F.array(*out)))
