"""What a tournament plays next: pending pairs, their information gain, and a choice within a budget."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.tables import stored

BETA2 = (25.0 / 6) ** 2


def gain(mu1: Column, sigma1: Column, mu2: Column, sigma2: Column) -> Column:
    """Both uncertainties times the chance of an even match."""
    whole = 2 * BETA2 + sigma1 * sigma1 + sigma2 * sigma2
    return (sigma1 + sigma2) * F.sqrt(F.lit(2 * BETA2) / whole) * F.exp(-F.pow(mu1 - mu2, F.lit(2)) / (2 * whole))


def highest(sigma1: Column, sigma2: Column) -> Column:
    """The gain of two rows of equal mu."""
    return gain(F.lit(0.0), sigma1, F.lit(0.0), sigma2)


def thinned(rated: DataFrame, key: str, k: int) -> DataFrame:
    """Of the rows that share mu and sigma the k + 1 of least key: any pair with another one comes after k pairs of the
    same gain and lower ids, so that it is not among the k best."""
    place = F.row_number().over(Window.partitionBy("mu", "sigma").orderBy(key))
    return rated.select(key, "mu", "sigma", place.alias("__place")).where(F.col("__place") <= k + 1).drop("__place")


def reached(close: DataFrame, k: int) -> float:
    """A gain that k of these pairs reach, less what rounding to nine digits may tie with it; 0 for fewer pairs."""
    got = close.where("gain is not null").orderBy(F.desc("gain")).limit(k).agg(F.min("gain").alias("g"), F.count("*").alias("n")).first()
    return max(got["g"] * (1 - 1e-9) - 1e-9, 0.0) if got["n"] == k else 0.0


def following(rows: DataFrame, key: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The gains of neighbours in mu, within groups."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("mu", key)
    close = None
    for n in range(1, 1 + max(1, -(-2 * k // 100))):
        part = rows.select(gain(F.col("mu"), F.col("sigma"), F.lead("mu", n).over(w), F.lead("sigma", n).over(w)).alias("gain"))
        close = part if close is None else close.unionByName(part)
    return close


def able(rated: DataFrame, key: str, k: int, probe: int = 1000) -> tuple[DataFrame, float, float] | None:
    """The rows that can be in one of the k best pairs, with what gain those reach and how far apart in mu they are;
    None for no rows. Neighbours in mu give that gain, first among the ``probe`` most uncertain rows, then among all
    rows that can reach the first one. Thinned rows are stored."""
    rated = stored(thinned(rated, key, k), "match-rows")
    top = rated.agg(F.max("sigma").alias("s"), F.min("mu").alias("lo"), F.max("mu").alias("hi")).first()
    if top["s"] is None:
        return None
    s, spread = top["s"], top["hi"] - top["lo"]
    partner = F.least(F.lit(s), F.col("sigma") + 2 * BETA2 / F.col("sigma"))  # with it a row gains most
    best = highest(F.col("sigma"), F.when(F.col("sigma") > 0, partner).otherwise(s))
    most = 2 * s * math.sqrt(2 * BETA2 / (2 * BETA2 + 2 * s * s))
    whole = 2 * BETA2 + 2 * s * s

    def within(bar: float) -> float:
        width = math.sqrt(2 * whole * max(math.log(most / bar), 0.0)) if bar else spread
        return max(width, spread / 1e6, 1e-9) * (1 + 1e-9)

    bar = reached(following(rated.orderBy(F.desc("sigma"), key).limit(probe), key, k), k)
    own = rated.where(best >= bar * (1 - 1e-9))
    span = min(within(bar), spread / 4096 or 1.0)
    bar = max(bar, reached(following(own.withColumn("span", F.floor(F.col("mu") / span)), key, k, ["sigma", "span"]), k))
    return own.where(best >= bar * (1 - 1e-9)), bar, within(bar)


def meetings(own: DataFrame, key: str, width: float) -> DataFrame:
    """Each pair of rows no farther apart in mu than the width, once."""
    own = own.withColumn("bucket", F.floor(F.col("mu") / width))
    other = own.select(F.col(key).alias("right_id"), F.col("mu").alias("mu2"), F.col("sigma").alias("sigma2"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    return own.join(other, "bucket").where((F.col(key) < F.col("right_id")) & (F.abs(F.col("mu") - F.col("mu2")) <= width))


def best_pairs(rated: DataFrame, key: str, k: int, probe: int = 1000) -> DataFrame:
    """left_id, right_id, gain: the k pairs of most gain among all unordered pairs of (key, mu, sigma) rows.

    A pair that reaches the gain of k known pairs needs enough uncertainty on both sides and a small enough gap in mu,
    whatever else holds: rows without that drop out, the others meet in buckets of mu as wide as that gap. Of equal rows
    only as many as k pairs need meet. Nothing is lost and no pool is formed.
    """
    found = able(rated, key, k, probe)
    if found is None:
        return rated.select(F.col(key).alias("left_id"), F.col(key).alias("right_id"), F.lit(0.0).alias("gain")).limit(0)
    own, bar, width = found
    scored = meetings(own, key, width).select(F.col(key).alias("left_id"), "right_id", gain(F.col("mu"), F.col("sigma"), F.col("mu2"), F.col("sigma2")).alias("gain")).where(F.col("gain") >= bar)
    return scored.orderBy(F.desc(F.round("gain", 9)), "left_id", "right_id").limit(k)


def pending(items: DataFrame, models: DataFrame, done: DataFrame, judge: str | None = None) -> DataFrame:
    """item, model_a, model_b, turned: ordered pairs of models that each item is still to be judged for; ``turned``
    tells whether the other orientation is done. ``models`` has (item, model): who answered what."""
    a = models.select("item", F.col("model").alias("model_a"))
    b = models.select("item", F.col("model").alias("model_b"))
    over = (done.where(F.col("judge") == judge) if judge else done).select("item", "model_a", "model_b").distinct()
    every = items.select("item").distinct().join(a, "item").join(b, "item").where("model_a != model_b")
    open_ = every.join(over, ["item", "model_a", "model_b"], "left_anti")
    back = over.select("item", F.col("model_a").alias("model_b"), F.col("model_b").alias("model_a"), F.lit(True).alias("turned"))
    return open_.join(back, ["item", "model_a", "model_b"], "left").withColumn("turned", F.coalesce("turned", F.lit(False)))


def selected(open_: DataFrame, gains: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """item, model_a, model_b, gain, reason: what to play next with ``budget`` battles.

    Pairs of which one orientation is done come first. Then one item of each unordered pair, both orientations
    together and never only one, by falling gain, for as long as two battles are left. ``gains``: (model_1, model_2,
    gain) of unordered pairs. The item is picked by a hash of seed and names, so that a repeated run picks alike.
    """
    pair = open_.select("item", "model_a", "model_b", "turned", F.least("model_a", "model_b").alias("model_1"), F.greatest("model_a", "model_b").alias("model_2")).join(gains, ["model_1", "model_2"])
    order = [F.desc(F.round("gain", 9)), "model_1", "model_2", "item"]
    first = pair.where("turned").orderBy(*order).limit(budget)
    n = first.count()
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("item").cast("string"), "model_1", "model_2"))
    unit = pair.where("not turned").groupBy("model_1", "model_2").agg(F.min_by("item", F.struct(mark.alias("m"), "item")).alias("item"), F.first("gain").alias("gain"))
    units = unit.orderBy(*order).limit((budget - n) // 2)
    both = F.explode(F.array(F.struct(F.col("model_1").alias("model_a"), F.col("model_2").alias("model_b")), F.struct(F.col("model_2").alias("model_a"), F.col("model_1").alias("model_b"))))
    new = units.select("item", both.alias("p"), "gain").select("item", "p.model_a", "p.model_b", "gain", F.lit("new").alias("reason"))
    return first.select("item", "model_a", "model_b", "gain", F.lit("completion").alias("reason")).unionByName(new)


def plus_margin(text: Column) -> Column:
    """The margin that a verdict's plus signs tell ('A0493+++' is 3), 0 for what is no such verdict."""
    return F.when(text.rlike(r"^A0(493|488)\++$"), F.length(F.regexp_extract(text, r"(\++)$", 1))).otherwise(0)


def valid_payload(criteria: Column, wanted: Sequence[str]) -> Column:
    """Whether a map of verdicts has exactly the wanted names, each a code with one to five plus signs."""
    names = F.array(*[F.lit(w) for w in wanted])
    whole = (F.size(F.array_except(names, F.map_keys(criteria))) == 0) & (F.size(F.array_except(F.map_keys(criteria), names)) == 0)
    return F.coalesce(whole & F.forall(F.map_values(criteria), lambda v: v.rlike(r"^A0(493|488)\+{1,5}$")), F.lit(False))
