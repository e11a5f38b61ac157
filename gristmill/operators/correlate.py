"""Pairwise-complete correlations and what is derived from them: selection, difficulty, redundancy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators import rank as R


def pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, r) for each pair of columns, over rows in which both are filled.

    One aggregation over the table whatever the number of pairs; its single row is then unfolded.
    """
    both = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"), F.corr(a, b).alias("r")) for a, b in both]
    return df.agg(F.array(*cells).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def rank_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, rho): Spearman's coefficient, ranks taken within the rows of each pair. Ranks come from counts of
    distinct values, summed up range by range. A column without nulls has the same ranks in all its pairs with others
    like it: those are joined once a column, and one aggregation gives all such pairs."""
    both = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    if not both:
        return df.sparkSession.createDataFrame([], "a string, b string, n long, rho double")
    names = {c: f"v{i}" for i, c in enumerate(columns)}
    own = df.select(*[F.col(c).cast("double").alias(n) for c, n in names.items()])
    gaps = own.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names.values()]).first()
    full = [c for c in columns if not gaps[names[c]]]
    ranked = own
    for c in full if len(full) > 1 else ():
        v = names[c]
        values = R.below(own.groupBy(v).agg(F.count("*").alias("n")), v, "n")
        ranked = ranked.join(values.select(v, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{v}")), v)
    whole = [(a, b) for a, b in both if a in full and b in full]
    out = []
    if whole:
        cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count("*").alias("n"), F.corr(f"r{names[a]}", f"r{names[b]}").alias("rho")) for a, b in whole]
        out.append(ranked.agg(F.array(*cells).alias("all")).select(F.inline("all")).where("n > 0"))
    if len(whole) < len(both):
        out.append(pairs_by_rows(df, [p for p in both if p not in whole]))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def pairs_by_rows(df: DataFrame, both: Sequence[tuple[str, str]]) -> DataFrame:
    """``rank_pairs`` of columns with nulls: each pair has rows, and so ranks, of its own."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in both])).alias("p")).select("p.*").where("x is not null and y is not null")
    long = rows.groupBy("a", "b", "x", "y").agg(F.count("*").alias("w"))
    for c in ("x", "y"):
        values = R.below(long.groupBy("a", "b", c).agg(F.sum("w").alias("n")), c, "n", ["a", "b"])
        long = long.join(values.select("a", "b", c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{c}")), ["a", "b", c])
    w, x, y = F.col("w"), F.col("rx"), F.col("ry")
    sums = long.groupBy("a", "b").agg(F.sum("w").alias("n"), *[F.sum(w * v).alias(k) for k, v in (("sx", x), ("sy", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))])
    n = F.col("n")
    spread = lambda p, q, r: F.col(r) - F.col(p) * F.col(q) / n
    rho = spread("sx", "sy", "xy") / F.sqrt(spread("sx", "sx", "xx") * spread("sy", "sy", "yy"))
    return sums.select("a", "b", "n", rho.alias("rho"))


def both_ways(pair: DataFrame) -> DataFrame:
    """(target, proxy, n, r): each pair from either side."""
    return pair.select(F.explode(F.array(F.struct(F.col("a").alias("target"), F.col("b").alias("proxy"), "n", "r"), F.struct(F.col("b").alias("target"), F.col("a").alias("proxy"), "n", "r"))).alias("x")).select("x.*")


def candidates(pair: DataFrame, least: int, k: int) -> DataFrame:
    """The k best proxies of each target by |r| * sqrt(n), among those with enough rows in common."""
    score = F.abs(F.col("r")) * F.sqrt("n")
    scored = both_ways(pair).where((F.col("n") >= least) & F.col("r").isNotNull()).withColumn("score", score)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "proxy"))).where(F.col("place") <= k)


def cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def mean_vectors(df: DataFrame, by: str, vector: str) -> DataFrame:
    """The mean vector of each group, brought to length 1. Elements are averaged one by one with map-side combination."""
    each = df.select(by, F.posexplode(vector).alias("i", "v")).groupBy(by, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    ordered = each.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("all"))
    norm = F.sqrt(F.aggregate("all", F.lit(0.0), lambda s, e: s + e["m"] * e["m"]))
    return ordered.select(by, F.transform("all", lambda e: e["m"] / norm).alias(vector))
