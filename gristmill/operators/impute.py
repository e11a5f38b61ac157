"""Filling a sparse matrix cell by cell, with the uncertainty of each cell.

Models are fitted from moments: one aggregation over the table gives the sums that every regression needs, the
small systems are solved on the driver (their size is that of the schema), and predictions go back into the plan as
column expressions. No rows leave the executors and no group is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.correlate import candidates, pairs
from gristmill.operators.exact import medians

#: Rows in common that a model needs at least, plus five for each predictor beyond the first.
LEAST = 10
#: A model in which one row decides alone is refused.
MAX_LEVERAGE = 0.95


def together(columns: Sequence[str]) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 0


def moments(df: DataFrame, target: str, predictors: Sequence[str]) -> Column:
    """n and all sums of products of (1, predictors, target) over complete rows, as one array aggregate."""
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in predictors], F.col(target).cast("double")]
    whole = together([*predictors, target])
    return F.array(*[F.coalesce(F.sum(F.when(whole, terms[i] * terms[j])), F.lit(0.0)) for i in range(len(terms)) for j in range(i + 1)])


def square(sums: Sequence[float]) -> np.ndarray:
    n = int((np.sqrt(8 * len(sums) + 1) - 1) / 2)
    out = np.zeros((n, n))
    out[np.tril_indices(n)] = sums
    return out + np.tril(out, -1).T


class Linear:
    """Bayesian ridge on standardised predictors from moments, by evidence maximisation."""

    def __init__(self, predictors: Sequence[str], m: np.ndarray, rounds: int = 300, tolerance: float = 1e-3):
        self.predictors, self.n = list(predictors), m[0, 0]
        n, k = self.n, len(predictors)
        mean = m[0] / n
        spread = m / n - np.outer(mean, mean)
        self.sd = np.sqrt(np.maximum(np.diag(spread)[1 : k + 1], 0))
        self.sd[self.sd == 0] = 1.0
        self.mean, self.level = mean[1 : k + 1], mean[k + 1]
        gram = spread[1 : k + 1, 1 : k + 1] / np.outer(self.sd, self.sd) * n
        cross = spread[1 : k + 1, k + 1] / self.sd * n
        yy = spread[k + 1, k + 1] * n
        noise, weight = 1 / max(yy / n, 1e-12), 1.0
        values = np.linalg.eigvalsh(gram)
        beta = np.zeros(k)
        for _ in range(rounds):
            before = beta
            beta = np.linalg.solve(gram + weight / noise * np.eye(k), cross)
            rss = max(yy - 2 * beta @ cross + beta @ gram @ beta, 1e-12)
            gamma = float((noise * values / (weight + noise * values)).sum())
            weight = (gamma + 2e-6) / (beta @ beta + 2e-6)
            noise = (n - gamma + 2e-6) / (rss + 2e-6)
            if np.abs(before - beta).sum() < tolerance:
                break
        self.beta, self.penalty = beta, weight / noise
        self.inverse = np.linalg.inv(gram + self.penalty * np.eye(k))
        self.sigma2 = 1 / noise

    def standard(self) -> list[Column]:
        return [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(self.predictors, self.mean, self.sd, strict=True)]

    def predicted(self) -> Column:
        return sum((z * F.lit(float(b)) for z, b in zip(self.standard(), self.beta, strict=True)), F.lit(float(self.level)))

    def leverage(self) -> Column:
        z = self.standard()
        return sum((z[i] * z[j] * F.lit(float(self.inverse[i, j])) for i in range(len(z)) for j in range(len(z))), F.lit(float(1 / self.n)))


def fitted(df: DataFrame, columns: Sequence[str], k: int = 2) -> dict[str, list[tuple[Linear, float]]]:
    """For each column its models, best first, with their leave-one-out variance.

    A model for each subset of the column's k best proxies; two aggregations in all, one for the moments and one
    for leverages and leave-one-out errors.
    """
    chosen: dict[str, list[str]] = {c: [] for c in columns}
    for r in candidates(pairs(df, columns), LEAST, k).collect():  # k rows for each column
        chosen[r["target"]].append(r["proxy"])
    sets = [(c, p) for c in columns for n in range(1, k + 1) for p in combinations(sorted(chosen[c]), n)]
    if not sets:
        return {c: [] for c in columns}
    sums = df.agg(*[moments(df, c, p).alias(f"m{i}") for i, (c, p) in enumerate(sets)]).first()
    models = []
    for i, (c, p) in enumerate(sets):
        m = square(sums[f"m{i}"])
        if m[0, 0] >= max(LEAST, 5 * (len(p) + 1)):
            models.append((c, Linear(p, m)))
    if not models:
        return {c: [] for c in columns}
    checks = []
    for i, (c, model) in enumerate(models):
        whole, h = together([*model.predictors, c]), model.leverage()
        e = (F.col(c) - model.predicted()) / (1 - h)
        checks += [F.avg(F.when(whole, e * e)).alias(f"e{i}"), F.max(F.when(whole, h)).alias(f"h{i}")]
    seen = df.agg(*checks).first()
    out: dict[str, list[tuple[Linear, float]]] = {c: [] for c in columns}
    for i, (c, model) in enumerate(models):
        if seen[f"h{i}"] <= MAX_LEVERAGE:
            out[c].append((model, seen[f"e{i}"]))
    return {c: sorted(own, key=lambda x: (x[1], x[0].predictors)) for c, own in out.items()}


def filled(df: DataFrame, key: str, columns: Sequence[str], k: int = 2) -> DataFrame:
    """(key, column, value, sigma2, origin) for each cell.

    Observed cells stay, with variance 0. A missing cell takes the model of least leave-one-out variance among those
    whose predictors are all observed in its row; without one it takes the column's median with the column's
    variance. A column without any value stays null.
    """
    return df.select(key, F.inline(F.array(*told(df, columns, k))))


def told(df: DataFrame, columns: Sequence[str], k: int = 2) -> list[Column]:
    """Each column's cell as ``filled`` gives it: (column, value, sigma2, origin)."""
    models = fitted(df, columns, k)
    stats = df.agg(*[F.variance(c).alias(c) for c in columns]).first()
    middle = medians(df, columns)
    cells = []
    for c in columns:
        value, sigma2, origin = F.lit(middle[c]).cast("double"), F.lit(stats[c]).cast("double"), F.lit("median")
        for model, loo in reversed(models[c]):
            usable = together(model.predictors)
            value = F.when(usable, model.predicted()).otherwise(value)
            sigma2 = F.when(usable, F.lit(float(loo))).otherwise(sigma2)
            origin = F.when(usable, "+".join(model.predictors)).otherwise(origin)
        there = F.col(c).isNotNull()
        cells.append(F.struct(F.lit(c).alias("column"), F.when(there, F.col(c).cast("double")).otherwise(value).alias("value"), F.when(there, 0.0).otherwise(sigma2).alias("sigma2"), F.when(there, "observed").otherwise(origin).alias("origin")))
    return cells


def trajectory(cells: DataFrame, key: str) -> DataFrame:
    """How far each row rests on imputed cells: mean and greatest sigma over the column's deviation, and their number."""
    spread = cells.where("origin = 'observed'").groupBy("column").agg(F.stddev("value").alias("sd"))
    delta = F.sqrt("sigma2") / F.col("sd")
    gone = F.col("origin") != "observed"
    return cells.join(F.broadcast(spread), "column").groupBy(key).agg(F.round(F.coalesce(F.avg(F.when(gone, delta)), F.lit(0.0)), 6).alias("mean_delta"), F.round(F.coalesce(F.max(F.when(gone, delta)), F.lit(0.0)), 6).alias("max_delta"), F.count_if(gone).alias("n_imputed"))


def coherent(cells: DataFrame, key: str, columns: Sequence[str], rank: int, strength: float = 8.0) -> DataFrame:
    """Imputed cells drawn towards the matrix's best approximation of low rank: weight 1 - exp(-t / strength), t
    being the cell's sigma over its column's deviation.

    The basis comes from the columns' covariance (one aggregation); rows are projected as expressions.
    """
    wide = cells.groupBy(key).pivot("column", list(columns)).agg(F.first("value").alias("value"), F.first("sigma2").alias("sigma2"), F.first("origin").alias("origin"))
    v = [F.col(f"`{c}_value`") for c in columns]
    stats = wide.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(v)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(v)]).first()
    mean, sd = [stats[f"m{i}"] for i in range(len(v))], [stats[f"s{i}"] or 1.0 for i in range(len(v))]
    z = [(x - F.lit(m)) / F.lit(s) for x, m, s in zip(v, mean, sd, strict=True)]
    gram = wide.agg(*[F.avg(z[i] * z[j]).alias(f"g{i}_{j}") for i in range(len(z)) for j in range(i + 1)]).first()
    g = square([gram[f"g{i}_{j}"] for i in range(len(z)) for j in range(i + 1)])
    basis = np.linalg.eigh(g)[1][:, ::-1][:, :rank]
    project = basis @ basis.T
    out = []
    for i, c in enumerate(columns):
        smooth = sum((z[j] * F.lit(float(project[i, j])) for j in range(len(z))), F.lit(0.0)) * F.lit(sd[i]) + F.lit(mean[i])
        w = 1 - F.exp(-F.sqrt(F.col(f"`{c}_sigma2`")) / F.lit(sd[i]) / strength)
        free = F.col(f"`{c}_origin`") != "observed"
        out.append(F.struct(F.lit(c).alias("column"), F.when(free, (1 - w) * v[i] + w * smooth).otherwise(v[i]).alias("value"), F.when(free, (1 - w) * (1 - w) * F.col(f"`{c}_sigma2`")).otherwise(0.0).alias("sigma2"), F.col(f"`{c}_origin`").alias("origin")))
    return wide.select(key, F.inline(F.array(*out)))


def held_out_errors(df: DataFrame, key: str, columns: Sequence[str], folds: int = 4, k: int = 2) -> DataFrame:
    """(column, n, mae, rmse, coverage): observed cells masked fold by fold (by a hash of key and column) and filled
    from the others. A masked cell's own value stands in its row, so that nothing is joined."""
    out = None
    for f in range(folds):
        fold = lambda c: F.pmod(F.xxhash64(key, F.lit(c)), F.lit(folds)) == f  # noqa: E731, B023
        masked = df.select(*[F.when(~fold(c), F.col(c)).alias(c) for c in columns], *[F.when(fold(c), F.col(c).cast("double")).alias(f"actual__{c}") for c in columns])
        cells = told(masked, columns, k)
        part = masked.select(F.inline(F.array(*[F.struct(x["column"].alias("column"), F.col(f"actual__{c}").alias("actual"), x["value"].alias("value"), x["sigma2"].alias("sigma2")) for c, x in zip(columns, cells, strict=True)]))).where("actual is not null")
        out = part if out is None else out.unionByName(part)
    e = F.abs(F.col("actual") - F.col("value"))
    return out.groupBy("column").agg(F.count("*").alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((e <= 1.96 * F.sqrt("sigma2")).cast("int")).alias("coverage"))


def importances(df: DataFrame, columns: Sequence[str], k: int = 2) -> list[tuple[str, str, float, float, int]]:
    """(column, predictor, share, loo, place): the model that tells most of each column's gaps (of those that fit, the
    one of least leave-one-out error), and its predictors by their share of the sum of |weight| on standardised values.
    A column that no model tells has no rows."""
    out = []
    for c, models in fitted(df, columns, k).items():
        if not models:
            continue
        model, loo = models[0]
        size = np.abs(model.beta)
        share = size / size.sum() if size.sum() > 0 else np.full(len(size), 1 / len(size))
        for place, i in enumerate(sorted(range(len(size)), key=lambda i: (-share[i], model.predictors[i]))):
            out.append((c, model.predictors[i], float(share[i]), float(loo), place + 1))
    return out
