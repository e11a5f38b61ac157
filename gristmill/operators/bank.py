"""A bank of models for gaps: which kind a column needs, which predictors, and a second pass over confident gaps.

As in ``impute``, everything is fitted from sums that one aggregation gives and applied as column expressions; what
comes to the driver grows with the number of columns, never with that of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.correlate import both_ways, pairs, rank_pairs
from gristmill.operators.exact import medians, quantiles
from gristmill.operators.impute import LEAST, MAX_LEVERAGE, Linear, square, together
from gristmill.operators.latent import array_sums as summed
from gristmill.tables import stored

#: Predictors of a model at most, and the share by which another one must lower the squared error.
CAP, GAIN = 8, 0.001
#: A gap that is filled from a filled cell needs sigma below this share of that column's deviation, and must lower the
#: variance to this share of what it was.
CONFIDENT, BETTER = 0.4, 0.95


def needed(k: int) -> int:
    """Rows in common that a model of k predictors needs."""
    return max(LEAST, 5 * (k + 1))


class Wide:
    """The columns of a frame as one array a row (nan where missing), stored for all passes of a fit."""

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        self.at = {c: i for i, c in enumerate(columns)}
        self.rows = stored(df.select(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns]).alias("x")), "bank-rows")

    def sums(self, add: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        return summed(self.rows, ["x"], add, size) if size else np.zeros(0)

    def numbers(self, columns: Sequence[str]) -> list[int]:
        return [self.at[c] for c in columns]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of (1, x, y) with themselves, over rows without gaps."""
    whole = ~(np.isnan(x).any(1) | np.isnan(y))
    one = np.c_[np.ones(whole.sum()), x[whole], y[whole]]
    return (one.T @ one).ravel()


def models_of(wide: Wide, asks: Sequence[tuple[str, Sequence[str]]]) -> list[tuple[Linear, float] | None]:
    """For each target and set of predictors the ridge and its leave-one-out squared error; None where rows are too few
    or one row decides alone. Two passes, however many there are."""
    at = [(wide.at[t], wide.numbers(p)) for t, p in asks]
    ends = np.cumsum([(len(p) + 2) ** 2 for _, p in at])
    sums = np.split(wide.sums(lambda x: np.concatenate([products(x[:, p], x[:, t]) for t, p in at]), int(ends[-1]) if len(at) else 0), ends[:-1]) if at else []
    models = []
    for (_, p), part in zip(asks, sums, strict=True):
        m = part.reshape(len(p) + 2, -1)
        models.append(Linear(p, m) if m[0, 0] >= needed(len(p)) else None)

    def left_out(x: np.ndarray) -> np.ndarray:
        out = []
        for (t, p), m in zip(at, models, strict=True):
            if m is None:
                out.append(np.zeros(3))
                continue
            v, y = x[:, p], x[:, t]
            whole = ~(np.isnan(v).any(1) | np.isnan(y))
            z = (v[whole] - m.mean) / m.sd
            h = np.einsum("ij,jk,ik->i", z, m.inverse, z) + 1 / m.n
            e = (y[whole] - m.level - z @ m.beta) / (1 - h)
            out.append(np.array([(e * e).sum(), len(e), (h > MAX_LEVERAGE).sum()]))
        return np.concatenate(out)

    seen = wide.sums(left_out, 3 * len(at)).reshape(-1, 3)
    return [(m, float(e / n)) if m and not bad else None for m, (e, n, bad) in zip(models, seen, strict=True)]


def linear_models(df: DataFrame, target: str, sets: Sequence[Sequence[str]]) -> list[tuple[Linear, float] | None]:
    """``models_of`` one target."""
    return models_of(Wide(df, list(dict.fromkeys([target, *(c for p in sets for c in p)]))), [(target, p) for p in sets]) if sets else []


def forwards(wide: Wide, candidates: dict[str, Sequence[str]], cap: int = CAP) -> dict[str, list[tuple[list[str], Linear, float]]]:
    """For each target the beginnings of its forward order, each with its model and error: the predictor that lowers
    the leave-one-out error most comes next, until none lowers it by GAIN. All targets take a step together, so that
    the number of passes is that of the steps."""
    found: dict[str, list[tuple[list[str], Linear, float]]] = {t: [] for t in candidates}
    open_ = list(candidates)
    for _ in range(cap):
        asks = []
        for t in open_:
            now = found[t][-1][0] if found[t] else []
            asks += [(t, [*now, c]) for c in candidates[t] if c not in now and c != t]
        got: dict[str, list] = {t: [] for t in open_}
        for (t, p), m in zip(asks, models_of(wide, asks), strict=True):
            if m:
                got[t].append((m[1], p[-1], p, m[0]))
        open_ = []
        for t, own in got.items():
            best = min(own, key=lambda v: v[:2]) if own else None
            if best and best[0] <= (found[t][-1][2] if found[t] else math.inf) * (1 - GAIN):
                found[t].append((best[2], best[3], best[0]))
                open_.append(t)
        if not open_:
            break
    return found


def forward(df: DataFrame, target: str, candidates: Sequence[str], cap: int = CAP) -> list[str]:
    """The forward order of one target."""
    found = forwards(Wide(df, list(dict.fromkeys([target, *candidates]))), {target: candidates}, cap)[target]
    return found[-1][0] if found else []


def mrmr(df: DataFrame, target: str, candidates: Sequence[str], k: int) -> list[str]:
    """k predictors by rank correlation with the target times how often they are there when it is missing, less their
    mean rank correlation with those already chosen."""
    columns = [target, *[c for c in candidates if c != target]]
    rho = {}
    for r in rank_pairs(df, columns).collect():  # a row a pair of columns
        rho[r["a"], r["b"]] = rho[r["b"], r["a"]] = abs(r["rho"] or 0.0)
    gone = F.col(target).isNull()
    there = df.agg(*[F.avg(F.when(gone, F.col(c).isNotNull().cast("int"))).alias(c) for c in columns[1:]]).first()
    chosen: list[str] = []
    while len(chosen) < k and (rest := [c for c in columns[1:] if c not in chosen]):
        score = lambda c: rho.get((target, c), 0.0) * (1.0 if there[c] is None else there[c]) - (sum(rho.get((c, o), 0.0) for o in chosen) / len(chosen) if chosen else 0.0)  # noqa: E731, B023
        chosen.append(max(rest, key=lambda c: (score(c), [-ord(x) for x in c])))
    return chosen


def kinds(df: DataFrame, columns: Sequence[str], forced: Sequence[str] = ()) -> DataFrame:
    """(column, kind): CATEGORICAL for few whole values or forced, NONLINEAR if ranks go together better than values by
    0.1, EXTRAPOLATION_PRONE for much missing and no close proxy, BOUNDED for shares without proxies, else LINEAR."""
    v = lambda c: F.col(c).cast("double")
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.count_distinct(c).alias("distinct"), F.coalesce(F.max(F.abs(v(c) - F.round(v(c)))), F.lit(0.0)).alias("off"), F.avg(F.col(c).isNull().cast("int")).alias("missing"),
            F.min(v(c)).alias("low"), F.max(v(c)).alias("high"),
        )
        for c in columns
    ]
    stats = df.agg(F.array(*cells).alias("x")).select(F.inline("x"))
    linear = both_ways(pairs(df, columns)).where("n >= 10").groupBy(F.col("target").alias("column")).agg(F.max(F.abs("r")).alias("r"))
    ranks = rank_pairs(df, columns).where("n >= 10").select(F.explode(F.array(F.struct(F.col("a").alias("column"), "rho"), F.struct(F.col("b").alias("column"), "rho"))).alias("x")).groupBy("x.column").agg(F.max(F.abs("x.rho")).alias("rho"))
    met = stats.join(linear, "column", "left").join(ranks, "column", "left")
    share = (F.col("low") >= 0) & (F.col("high") <= 100)
    kind = (
        F.when(F.col("column").isin(list(forced)) | ((F.col("distinct") <= 10) & (F.col("off") <= 1e-6)), "CATEGORICAL")
        .when(F.col("r").isNull(), F.when(share, "BOUNDED").otherwise("GAUSSIAN"))
        .when(F.col("rho") > F.col("r") + 0.1, "NONLINEAR")
        .when((F.col("missing") > 0.3) & (F.col("r") < 0.6), "EXTRAPOLATION_PRONE")
        .otherwise("LINEAR")
    )
    return met.select("column", kind.alias("kind"), share.alias("bounded"))


def floors(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(threshold, mean of the floor) of the columns whose values crowd at their floor with a valley above.

    At least 20 values, 15 % of them in the bottom quarter of the range and 10 above it; of the places at 10 to 40 %
    of the sorted values that have 15 % below them the widest step must be 5 % of the range; then the floor has 5
    values and the rest 10. Steps come from exact percentiles, of all columns together.
    """
    if not columns:
        return {}
    name = lambda n, c: f"{n}__{c}"
    r = df.agg(*[f(c).alias(name(n, c)) for c in columns for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    wide = {c: r[name("hi", c)] - r[name("lo", c)] for c in columns if r[name("n", c)] >= 20}
    wide = {c: w for c, w in wide.items() if w >= 1e-8}
    if not wide:
        return {}
    low = df.agg(*[F.count_if(F.col(c) <= r[name("lo", c)] + 0.25 * w).alias(c) for c, w in wide.items()]).first()
    places = {}
    for c in wide:
        n = r[name("n", c)]
        if low[c] >= 0.15 * n and n - low[c] >= 10:
            places[c] = [k for k in (int(p / 100 * n) for p in range(10, 45, 5)) if 0 < k < n - 10 and k / n >= 0.15]
    at = quantiles(df, {c: [x / (r[name("n", c)] - 1) for k in own for x in (k - 1, k)] for c, own in places.items() if own})
    cuts = {}
    for c, v in at.items():
        step, threshold = max((v[2 * i + 1] - v[2 * i], -i, v[2 * i + 1]) for i in range(len(places[c])))[::2]
        if step >= 0.05 * wide[c]:
            cuts[c] = threshold
    if not cuts:
        return {}
    seen = df.agg(*[x.alias(name(k, c)) for c, t in cuts.items() for k, x in (("n", F.count_if(F.col(c) <= t)), ("m", F.avg(F.when(F.col(c) <= t, F.col(c)))))]).first()
    return {c: (t, seen[name("m", c)]) for c, t in cuts.items() if seen[name("n", c)] >= 5 and r[name("n", c)] - seen[name("n", c)] >= 10}


def floor_of(df: DataFrame, c: str) -> tuple[float, float] | None:
    return floors(df, [c]).get(c)


class Gate:
    """A fitted logistic regression with balanced classes and a ridge."""

    def __init__(self, predictors: Sequence[str], n: float, positive: float, mean: np.ndarray, sd: np.ndarray):
        self.predictors, self.n, self.positive, self.mean, self.sd = list(predictors), n, positive, mean, sd
        self.beta = np.zeros(len(predictors) + 1)

    def chance(self) -> Column:
        z = F.lit(float(self.beta[0]))
        for c, m, s, b in zip(self.predictors, self.mean, self.sd, self.beta[1:], strict=True):
            z = z + (F.col(c) - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(b))
        return 1 / (1 + F.exp(-z))


def gates(wide: Wide, asks: Sequence[tuple[Sequence[str], str, Callable[[np.ndarray], np.ndarray]]], ridge: float = 1.0, rounds: int = 15) -> list[Gate]:
    """Gates of (predictors, target, what makes its values a label), all by the same Newton rounds: one pass a round."""
    at = [(wide.numbers(p), wide.at[t], label) for p, t, label in asks]

    def rows(x: np.ndarray, p: list[int], t: int, label: Callable) -> tuple[np.ndarray, np.ndarray]:
        whole = ~(np.isnan(x[:, p]).any(1) | np.isnan(x[:, t]))
        return x[whole][:, p], label(x[whole, t]).astype(np.float64)

    def measure(x: np.ndarray) -> np.ndarray:
        out = []
        for p, t, label in at:
            v, y = rows(x, p, t, label)
            out += [[len(y), y.sum()], v.sum(0), (v * v).sum(0)]
        return np.concatenate(out)

    ends = np.cumsum([2 + 2 * len(p) for p, _, _ in at])
    out = []
    for (p, _, _), s in zip(asks, np.split(wide.sums(measure, int(ends[-1]) if len(at) else 0), ends[:-1]) if at else [], strict=True):
        n, k = max(s[0], 1), len(p)
        mean = s[2 : 2 + k] / n
        sd = np.sqrt(np.maximum(s[2 + k :] / n - mean**2, 0))
        out.append(Gate(p, s[0], s[1], mean, np.where(sd > 0, sd, 1.0)))
    open_ = [i for i, g in enumerate(out) if 0 < g.positive < g.n]
    for _ in range(rounds):
        if not open_:
            break
        now = list(open_)

        def slopes(x: np.ndarray, now=now) -> np.ndarray:
            parts = []
            for i in now:
                g = out[i]
                v, y = rows(x, *at[i])
                one = np.c_[np.ones(len(v)), (v - g.mean) / g.sd]
                chance = 1 / (1 + np.exp(-np.clip(one @ g.beta, -700, 700)))
                w = np.where(y > 0, g.n / (2 * g.positive), g.n / (2 * (g.n - g.positive)))
                parts += [one.T @ (w * (y - chance)), ((one * (w * chance * (1 - chance))[:, None]).T @ one).ravel()]
            return np.concatenate(parts)

        sizes = [len(out[i].beta) for i in now]
        ends = np.cumsum([k + k * k for k in sizes])
        open_ = []
        for i, k, s in zip(now, sizes, np.split(wide.sums(slopes, int(ends[-1])), ends[:-1]), strict=True):
            keep = np.diag([0.0] + [ridge] * (k - 1))
            step = np.linalg.solve(s[k:].reshape(k, k) + keep + 1e-9 * np.eye(k), s[:k] - keep @ out[i].beta)
            out[i].beta = out[i].beta + step
            if np.abs(step).max() >= 1e-8:
                open_.append(i)
    return out


@dataclass
class Bounded:
    """A ridge on the logit scale between the column's own bounds; its error is taken in original units."""

    target: str
    model: Linear
    low: float
    width: float
    edge: float

    def logit(self) -> Column:
        share = F.greatest(F.lit(self.edge), F.least(F.lit(1 - self.edge), (F.col(self.target) - self.low) / self.width))
        return F.ln(share / (1 - share))

    def _back(self, z: Column) -> Column:
        return self.low + self.width / (1 + F.exp(-z))

    def predicted(self) -> Column:
        return self._back(self.model.predicted())

    def squared(self) -> Column:
        """The squared error with the row itself left out."""
        z = self.logit()
        e = F.col(self.target) - self._back(z - (z - self.model.predicted()) / (1 - self.model.leverage()))
        return e * e


@dataclass
class Hurdle:
    """A gate into the part above the floor times a ridge on that part; E = p * above + (1 - p) * floor."""

    target: str
    model: Linear
    gate: Gate
    floor: float

    def predicted(self) -> Column:
        p = self.gate.chance()
        return p * self.model.predicted() + (1 - p) * self.floor

    def squared(self) -> Column:
        e = F.col(self.target) - self.predicted()
        return e * e


@dataclass
class Classes:
    """The likeliest of a few values, each against the rest (of two values one gate tells both); the variance is what
    the chances, made to add up to 1, leave around their mean on the values' own scale."""

    target: str
    values: list[float]
    gates: list[Gate]

    def chances(self) -> list[Column]:
        if len(self.values) == 2:
            p = self.gates[0].chance()
            return [1 - p, p]
        each = [g.chance() for g in self.gates]
        total = sum(each, F.lit(0.0))
        return [p / total for p in each]

    def predicted(self) -> Column:
        pairs_ = F.array(*[F.struct(p.alias("p"), F.lit(float(v)).alias("v")) for p, v in zip(self.chances(), self.values, strict=True)])
        return F.array_max(pairs_)["v"]

    def squared(self) -> Column:
        p = self.chances()
        mean = sum((c * float(v) for c, v in zip(p, self.values, strict=True)), F.lit(0.0))
        return sum((c * float(v) * float(v) for c, v in zip(p, self.values, strict=True)), F.lit(0.0)) - mean * mean


#: Values of a column that a model of classes tells apart at most.
MOST_CLASSES = 10


def bank_of(df: DataFrame, columns: Sequence[str], kind: dict[str, str], bounded: dict[str, bool], cap: int = CAP) -> dict[str, list[tuple[list[str], object, float, str]]]:
    """For each column the beginnings of its forward order, the longest first, with the model that its kind asks for:
    (predictors, model, squared error, name). Passes grow with ``cap``, not with the number of columns."""
    wide = Wide(df, columns)
    orders = forwards(wide, {c: [o for o in columns if o != c] for c in columns}, cap)
    asked = [c for c in columns if orders[c]]
    low = floors(df, asked)
    name = lambda n, c: f"{n}__{c}"
    facts = [x.alias(name(k, c)) for c in asked for k, x in (("n", F.count(c)), ("lo", F.min(F.col(c).cast("double"))), ("hi", F.max(F.col(c).cast("double"))))]
    few = [c for c in asked if kind[c] == "CATEGORICAL"]
    # a set that holds one value too many is as good as a larger one
    r = df.agg(*facts, *[F.slice(F.sort_array(F.collect_set(F.col(c).cast("double"))), 1, MOST_CLASSES + 1).alias(name("v", c)) for c in few]).first() if asked else None
    values = {c: list(r[name("v", c)]) for c in few if 2 <= len(r[name("v", c)]) <= MOST_CLASSES}
    gate_asks, owners = [], []
    for c in asked:
        for p, _, _ in orders[c]:
            if c in values:
                picked = values[c][1:] if len(values[c]) == 2 else values[c]
                for v in picked:
                    gate_asks.append((p, c, lambda t, v=v: t == v))
                    owners.append((c, len(p), "classes"))
            elif c in low:
                gate_asks.append((p, c, lambda t, v=low[c][0]: t > v))
                owners.append((c, len(p), "hurdle"))
    fitted: dict[tuple, list[Gate]] = {}
    for key, g in zip(owners, gates(wide, gate_asks), strict=True):
        fitted.setdefault(key, []).append(g)
    made: list[tuple[str, list[str], object, str]] = []
    for c in asked:
        for p, _, _ in orders[c]:
            if c in values:
                made.append((c, p, Classes(c, values[c], fitted[c, len(p), "classes"]), "binary" if len(values[c]) == 2 else "classes"))
    rest = [(c, p) for c in asked if c not in values for p, _, _ in orders[c]]
    shells = {c: Bounded(c, None, float(r[name("lo", c)]), float(r[name("hi", c)] - r[name("lo", c)]) or 1.0, max(1e-3, 0.5 / (r[name("n", c)] + 1))) for c in asked}
    above = {c: (lambda t, v=low[c][0]: np.where(t > v, t, np.nan)) for c in low}
    link = {c: (lambda t, b=shells[c]: _logits(t, b)) for c in asked if bounded[c]}
    seconds = [(c, p, n, f[c]) for n, f in (("hurdle", above), ("bounded", link)) for c, p in rest if c in f]
    ends = np.cumsum([(len(p) + 2) ** 2 for _, p, _, _ in seconds])
    at = [(wide.numbers(p), wide.at[c], f) for c, p, _, f in seconds]
    sums = np.split(wide.sums(lambda x: np.concatenate([products(x[:, p], f(x[:, t])) for p, t, f in at]), int(ends[-1])), ends[:-1]) if seconds else []
    for (c, p, n, _), part in zip(seconds, sums, strict=True):
        m = part.reshape(len(p) + 2, -1)
        if n == "hurdle" and m[0, 0] >= needed(len(p)):
            made.append((c, p, Hurdle(c, Linear(p, m), fitted[c, len(p), "hurdle"][0], low[c][1]), n))
        elif n == "bounded" and m[0, 0] >= 1:
            made.append((c, p, replace(shells[c], model=Linear(p, m)), n))
    seen = df.agg(*[F.avg(F.when(together([*p, c]), m.squared())).alias(str(i)) for i, (c, p, m, _) in enumerate(made)]).first() if made else []
    better: dict[tuple[str, int], tuple] = {}
    for (c, p, m, n), error in zip(made, seen, strict=True):
        base = orders[c][len(p) - 1][2]
        if error is not None and (n != "bounded" or (error < base and (c, len(p)) not in better)):
            better[c, len(p)] = (m, float(error), n)
    return {c: [(p, *better.get((c, len(p)), (m, e, "linear"))) for p, m, e in reversed(orders[c])] for c in columns}


def _logits(t: np.ndarray, b: Bounded) -> np.ndarray:
    share = np.clip((t - b.low) / b.width, b.edge, 1 - b.edge)
    return np.log(share / (1 - share))


def filled(df: DataFrame, key: str, columns: Sequence[str], cap: int = 3) -> DataFrame:
    """(key, column, value, sigma2, origin) of each cell.

    First pass: a gap takes the longest beginning of its column's forward order that its row has; without any, the
    median with the column's variance. Second pass: a gap that only the median could fill, or that a model with one
    more predictor fills better, may use one predictor that the first pass filled confidently; its own variance comes
    on top (beta squared times). All gaps are judged on the state after the first pass.
    """
    told = {r["column"]: r for r in kinds(df, columns).collect()}  # a row a column
    middle, spread = medians(df, columns), df.agg(*[F.variance(c).alias(c) for c in columns]).first()
    chosen = bank_of(df, columns, {c: told[c]["kind"] for c in columns}, {c: bool(told[c]["bounded"]) for c in columns}, cap)
    first = {}
    for c in columns:
        value, sigma2, origin = F.lit(middle[c]).cast("double"), F.lit(spread[c]).cast("double"), F.lit("median")
        for p, model, error, name in reversed(chosen[c]):
            usable = together(p)
            value, sigma2, origin = F.when(usable, model.predicted()).otherwise(value), F.when(usable, F.lit(float(error))).otherwise(sigma2), F.when(usable, f"{name}:{'+'.join(p)}").otherwise(origin)
        there = F.col(c).isNotNull()
        first[c] = F.struct(F.when(there, F.col(c).cast("double")).otherwise(value).alias("value"), F.when(there, 0.0).otherwise(sigma2).alias("sigma2"), F.when(there, "observed").otherwise(origin).alias("origin"))
    wide = df.select(key, *[first[c].alias(c) for c in columns])
    state = wide.select(key, *[F.col(f"{c}.value").alias(c) for c in columns], *[F.col(f"{c}.sigma2").alias(f"{c}__s2") for c in columns], *[F.col(f"{c}.origin").alias(f"{c}__from") for c in columns])
    cells = []
    for c in columns:
        value, sigma2, origin = F.col(c), F.col(f"{c}__s2"), F.col(f"{c}__from")
        for p, model, error, name in chosen[c]:
            if name != "linear":
                continue
            for i, x in enumerate(p):
                others = [F.col(f"{o}__from") == "observed" for o in p if o != x]
                alone = (F.col(f"{x}__from") != "observed") & (F.sqrt(F.col(f"{x}__s2")) < CONFIDENT * math.sqrt(spread[x] or 1.0))
                slope = float(model.beta[i] / model.sd[i])
                total = float(error) + slope * slope * F.col(f"{x}__s2")
                take = (F.col(f"{c}__from") != "observed") & alone & (total < BETTER * sigma2)
                for o in others:
                    take = take & o
                value, sigma2, origin = F.when(take, model.predicted()).otherwise(value), F.when(take, total).otherwise(sigma2), F.when(take, f"second:{'+'.join(p)}").otherwise(origin)
        cells.append(F.struct(F.lit(c).alias("column"), value.alias("value"), sigma2.alias("sigma2"), origin.alias("origin")))
    return state.select(key, F.inline(F.array(*cells)))


def partial_correlations(df: DataFrame, columns: Sequence[str], ridge: float = 1e-4) -> DataFrame:
    """(a, b, r): correlation of two columns with all others held, from the inverse of the correlation matrix."""
    at = {c: i for i, c in enumerate(columns)}
    m = np.eye(len(columns)) * (1 + ridge)
    for r in pairs(df, columns).collect():  # a row a pair of columns
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["r"] or 0.0
    inverse = np.linalg.inv(m)
    scale = np.sqrt(np.diag(inverse))
    part = -inverse / np.outer(scale, scale)
    rows = [(a, b, float(part[at[a], at[b]])) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def contributions(df: DataFrame, target: str, predictors: Sequence[str], least: float = 0.01) -> dict[str, float]:
    """Each predictor's share of what a ridge explains: size of its coefficient times its deviation; small ones go."""
    got = linear_models(df, target, [predictors])[0]
    if not got:
        return {}
    size = np.abs(got[0].beta)  # on standardised predictors
    share = size / size.sum() if size.sum() else size
    return {c: float(s) for c, s in zip(predictors, share, strict=True) if s >= least}


def completed(df: DataFrame, key: str, columns: Sequence[str], rank: int, rounds: int = 30, tolerance: float = 1e-4) -> DataFrame:
    """(key, columns): gaps from the matrix's best approximation of that rank, found by alternating between the
    approximation and the gaps it fills. Gaps begin at the median.

    The rows of a round are projected as expressions on the eigenvectors of the columns' covariance (one aggregation);
    each round's rows are kept for the next.
    """
    spark, middle = df.sparkSession, medians(df, columns)
    keep = (lambda x: x.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda x: x.cache())
    gone = [F.col(c).isNull().alias(f"{c}__gone") for c in columns]
    own = keep(df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(middle[c]), F.lit(0.0)).alias(c) for c in columns], *gone))
    sd = [own.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()[c] or 1.0 for c in columns]
    for _ in range(rounds):
        x = [F.col(c) / s for c, s in zip(columns, sd, strict=True)]
        n = len(columns)
        sums = own.agg(F.array(*[F.avg(v) for v in x]).alias("m"), F.array(*[F.avg(x[i] * x[j]) for i in range(n) for j in range(i + 1)]).alias("g")).first()
        mean = np.array(sums["m"])
        basis = np.linalg.eigh(square(sums["g"]) - np.outer(mean, mean))[1][:, ::-1][:, :rank]
        project = basis @ basis.T
        fit = [(sum(((x[j] - float(mean[j])) * float(project[i, j]) for j in range(n)), F.lit(0.0)) + float(mean[i])) * sd[i] for i in range(n)]
        next_ = keep(own.select(key, *[F.when(F.col(f"{c}__gone"), fit[i]).otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)], *[f"{c}__gone" for c in columns], *[F.when(F.col(f"{c}__gone"), F.pow((fit[i] - F.col(c)) / sd[i], F.lit(2))).alias(f"{c}__step") for i, c in enumerate(columns)]))
        step = next_.agg(F.sqrt(F.avg(F.array_max(F.array(*[F.coalesce(f"{c}__step", F.lit(0.0)) for c in columns]))))).first()[0] or 0.0
        own = next_.select(key, *columns, *[f"{c}__gone" for c in columns])
        if step < tolerance:
            break
    return own.select(key, *columns)


def best_rank(df: DataFrame, key: str, columns: Sequence[str], ranks: Sequence[int], share: int = 10) -> int:
    """The rank with the least error on every ``share``-th observed cell, by a hash of key and column, masked before."""
    masked = lambda c: F.pmod(F.xxhash64(key, F.lit(c)), F.lit(share)) == 0
    open_ = df.select(key, *[F.when(~masked(c), F.col(c)).alias(c) for c in columns])
    sd = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    errors = []
    for rank in ranks:
        got = completed(open_, key, columns, rank).select(F.col(key).alias("__k"), *[F.col(c).alias(f"{c}__fit") for c in columns])
        met = df.join(got, F.col(key) == F.col("__k"))
        e = [F.avg(F.when(masked(c) & F.col(c).isNotNull(), F.pow((F.col(c) - F.col(f"{c}__fit")) / (sd[c] or 1.0), F.lit(2)))).alias(c) for c in columns]
        row = met.agg(*e).first()
        errors.append((sum(v for v in row if v is not None), rank))
    return min(errors)[1]
