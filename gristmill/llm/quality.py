"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled good, the unlabelled side is web text as it comes. The class prior is
estimated from the two samples: a first classifier tells positives from unlabelled text, and the prior is the least
ratio of unlabelled to positive mass above any of its scores (the purest top bin). The final model minimises

    prior * risk(positives as good) + max(0, risk(unlabelled as bad) - prior * risk(positives as bad))

with logistic loss; steps in which the second term falls below zero push it back up instead. The model is additive
over quantile bins of text statistics, which are shares and ratios of the whole text.

Both training samples are bounded (``SAMPLE`` rows each, drawn by a hash of doc_id); scores cover every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import crc_of_id, mapped, only

#: Rows of each training sample, in expectation.
SAMPLE = 12_000
BINS = 16
THRESHOLD = 0.3
FOLDS = 5
STATISTICS = (
    "words", "word_length", "distinct", "repeats", "top_share", "upper", "capitalised", "digits", "letters", "bangs",
    "bars", "symbols", "stops", "lines", "line_repeats", "short_words", "beyond_ascii", "longest_word",
)
SYMBOLS = str.maketrans("", "", "#$%&*+/<=>@\\^_`{}~[]")


def statistics(text: str | None) -> list[float]:
    """One number for each of STATISTICS; null counts as empty."""
    text = text if isinstance(text, str) else ""
    words = text.split()
    n, m = max(1, len(words)), max(1, len(text))
    low = [w.lower() for w in words]
    seen: dict[str, int] = {}
    for w in low:
        seen[w] = seen.get(w, 0) + 1
    lines = text.split("\n")
    joined = "".join(words)
    ascii_ = joined.encode("ascii", "ignore")
    upper = sum(map(str.isupper, words))
    letters = len(joined) - len(joined.translate(LETTERS))
    return [
        math.log1p(len(words)),
        len(joined) / n,
        len(seen) / n,
        sum(a == b for a, b in zip(low, low[1:], strict=False)) / n,
        max(seen.values(), default=0) / n,
        upper / n,
        sum(w[0].isupper() for w in words) / n,
        sum(ascii_.count(c) for c in b"0123456789") / m,
        letters / m,
        text.count("!") / n,
        text.count("|") / n,
        (len(text) - len(text.translate(SYMBOLS))) / n,
        (text.count(".") + text.count("?")) / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        sum(len(w) < 4 for w in words) / n,
        1 - len(ascii_) / max(1, len(joined)),
        math.log1p(max(map(len, words), default=0)),
    ]


LETTERS = str.maketrans("", "", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def table_of(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(STATISTICS))


class Additive:
    """A logistic model with one weight for each quantile bin of each statistic."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, bias: float):
        self.edges, self.weights, self.bias = edges, weights, bias

    @staticmethod
    def cut(x: np.ndarray) -> list[np.ndarray]:
        """Edges that part the rows evenly; the finest ones lie at the ends, where odd texts are."""
        at = np.concatenate(([0.002, 0.01, 0.03], np.linspace(0.07, 0.93, BINS - 7), [0.97, 0.99, 0.998]))
        return [np.unique(np.quantile(x[:, j], at)) if len(x) else np.zeros(0) for j in range(x.shape[1])]

    @staticmethod
    def places(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") + j * BINS for j, e in enumerate(edges)], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.places(self.edges, x)].sum(1) + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x)) if len(x) else np.zeros(0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def one_hot(places: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(places), width), np.float32)
    out[np.arange(len(places))[:, None], places] = 1
    return out


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, seed: int = 17) -> tuple[Additive, float]:
    """The model and the class prior that it was trained with."""
    if not len(positive) or not len(unlabelled):
        return Additive([np.zeros(0)] * len(STATISTICS), np.zeros(BINS * len(STATISTICS)), 0.0), 0.5
    edges = Additive.cut(np.concatenate([positive, unlabelled]))
    width = BINS * len(STATISTICS)
    p, u = (one_hot(Additive.places(edges, x), width) for x in (positive, unlabelled))
    if prior is None:
        first = descend(p, u, None, seed)
        prior = class_prior(p[1::2] @ first[0] + first[1], u[1::2] @ first[0] + first[1]) if len(p) > 1 and len(u) > 1 else 0.5
    weights, bias = descend(p, u, prior, seed)
    bias += math.log(THRESHOLD / (1 - THRESHOLD)) - cut_point(p @ weights + bias, u @ weights + bias, prior)
    return Additive(edges, weights, bias), prior


def cut_point(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The logit at which the non-negative risk of the decision itself (zero-one loss) is least, in the middle of
    all such; scores are shifted so that it is the decision threshold."""
    ps, us = np.sort(positive), np.sort(unlabelled)
    at = np.unique(us)
    missed = np.searchsorted(ps, at) / len(ps)
    taken = 1 - np.searchsorted(us, at) / len(us)
    risk = prior * missed + np.maximum(0, taken - prior * (1 - missed))
    return float(np.median(at[risk <= risk.min() + 1 / len(us)]))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of unlabelled to positive mass above a score, with an upper confidence bound for each."""
    at = np.unique(np.quantile(positive, np.linspace(0, 0.9, 200)))
    ps, us = np.sort(positive), np.sort(unlabelled)
    p = 1 - np.searchsorted(ps, at) / len(ps)
    u = 1 - np.searchsorted(us, at) / len(us)
    margin = np.sqrt(np.log(20) / (2 * len(ps))) + np.sqrt(np.log(20) / (2 * len(us)))
    k = np.argmin((u + margin) / np.maximum(p, 1e-9))
    return float(np.clip(u[k] / max(p[k], 1e-9), 0.01, 0.99))


def descend(p: np.ndarray, u: np.ndarray, prior: float | None, seed: int, epochs: int = 50, batch: int = 1000) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk; without a prior, plain positive-against-unlabelled logistic regression
    on every second row, whose other rows then serve to estimate the prior."""
    draw = np.random.default_rng(seed)
    if prior is None:
        p, u = p[::2], u[::2]
    w = np.zeros(p.shape[1] + 1)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    steps = max(1, max(len(p), len(u)) // batch)
    for epoch in range(epochs):
        rate = 0.1 / (1 + epoch / 10)
        for _ in range(steps):
            a, b = p[draw.integers(0, len(p), batch)], u[draw.integers(0, len(u), batch)]
            za, zb = a @ w[:-1] + w[-1], b @ w[:-1] + w[-1]
            up, down, bad = -sigmoid(-za), sigmoid(za), sigmoid(zb)  # slopes of the three losses in z
            gap = np.logaddexp(0, zb).mean() - (prior or 0) * np.logaddexp(0, za).mean()
            if prior is None:
                ga, gb = up, bad
            elif gap >= 0:
                ga, gb = prior * up - prior * down, bad
            else:
                ga, gb = prior * down, -bad
            g = np.append(a.T @ ga + b.T @ gb, ga.sum() + gb.sum()) / batch + 3e-5 * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of_id(doc_id) % FOLDS == 0, F.lit(False))


def drawn(key: Column, rows: int, of: int) -> Column:
    """True for about ``rows`` of ``of`` rows, by a hash of the key."""
    return F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(1, of)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Additive, float]:
    """Model and class prior from bounded samples of rows that are not held out.

    A document with both labels, or with null, is no trusted positive.
    """
    good = only(labels, "doc_id", "quality").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("low"), F.count("quality").alias("n"), F.count("*").alias("all"))
    good = good.where("low = 1 and n = `all`").select("doc_id")
    # Bounded: ``sample`` ids in expectation.
    trusted = good.where(drawn(F.col("doc_id"), sample, good.count())).withColumn("trusted", F.lit(True))
    open_ = only(docs, "doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = open_.join(F.broadcast(trusted), "doc_id", "left").withColumn("web", drawn(F.col("doc_id").bitwiseXOR(F.lit(0x5EED)), sample, open_.count()))
    rows = rows.where("trusted or web").select(F.coalesce("trusted", F.lit(False)).alias("trusted"), "web", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"trusted": frame["trusted"], "web": frame["web"], "x": list(table_of(frame["text"].tolist()))})

    got = rows.mapInPandas(run, "trusted boolean, web boolean, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(STATISTICS))
    order = np.lexsort(x.T)  # the same model however the rows were read
    x, trusted_, web = x[order], got["trusted"].to_numpy(bool)[order], got["web"].to_numpy(bool)[order]
    return fit(x[trusted_], x[web])


def with_score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All columns of ``docs`` as they came, and __score."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample)[0])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(__score=model.value.scores(table_of(frame["text"].tolist())))

    return mapped(docs, run, "__score double")


RESULTS = ("held_out", "score", "predicted")


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All columns of ``docs`` (own ones of the same names replaced) with held_out, score and predicted.

    Null and empty texts get the score of a text without words; without any trusted positive every score is 0.5. Very
    long texts are read whole, equal texts have equal scores, repeated rows are rows of their own, a null doc_id is
    never held out nor learned from, and an empty table gives an empty result.
    """
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULTS])
    score = F.col("__score")
    added = [held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted")]
    return with_score(base, labels, sample).select(*[F.col(f"`{c}`") for c in base.columns], *added)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier takes for good, with the columns that they came with; cases as in ``scored``."""
    return with_score(docs, labels).where(F.col("__score") >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; cases as in ``scored``."""
    return scored(only(docs, "doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")
