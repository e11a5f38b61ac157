"""Queries on tree ensembles: important columns, candidates for a score, votes and stacks without leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import trees
from gristmill.registering import Queries
from gristmill.session import table

queries = Queries()
COLUMNS = ["lines", "quantity", "discount", "tax", "customer_balance", "nation"]


def priced_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with what their lines and customers say and the worth of their lines, which is open while they are in progress."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.sum("l_extendedprice").alias("worth"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("customer_balance"), F.col("c_nationkey").alias("nation"))
    price = F.when(F.col("o_orderstatus") != "P", F.col("worth")).alias("price")
    return table(spark, d, "orders").join(lines, "o_orderkey", "left").join(customers, "o_custkey", "left").select("o_orderkey", *COLUMNS, price)


def binned(spark: SparkSession, d: str, columns: list[str] = COLUMNS) -> trees.Binned:
    return trees.Binned.of(priced_orders(spark, d), "o_orderkey", columns, "price", folds=5)


def drawn(n: int = 6) -> trees.Forest:
    return trees.Forest(n_trees=n, depth=5, least=10, random_cuts=True, seed=42)


@queries.add("important_columns")
def important_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns that take most off the squared error in extremely random trees."""
    best = trees.top_columns(drawn().fit(binned(spark, d)), COLUMNS, 4)
    return spark.createDataFrame([(k + 1, c, v) for k, (c, v) in enumerate(best)], "place int, column string, importance double")


@queries.add("voted_prices")
def voted_prices(spark: SparkSession, d: str) -> DataFrame:
    """Random and boosted trees on the most important columns, averaged; priced orders get what was told without them."""
    own = [c for c, _ in trees.top_columns(drawn().fit(binned(spark, d)), COLUMNS, 4)]
    data = binned(spark, d, own)
    return trees.voted(data, [drawn().fit(data), trees.Boosted(depth=3, rounds=10, rate=0.3, least=10).fit(data)])


@queries.add("candidate_models")
def candidate_models(spark: SparkSession, d: str) -> DataFrame:
    """Models for the price, compared where they have not seen the row, higher prices weighing more."""
    data = binned(spark, d)
    models = [
        ("mean", trees.Line()), ("one line", trees.Line([1])), ("ridge", trees.Line(range(len(COLUMNS)))), ("forest", trees.Forest(n_trees=6, depth=5, least=10)),
        ("random trees", drawn()), ("stumps", trees.Boosted(depth=1, rounds=10, rate=0.5, least=10)), ("boosted", trees.Boosted(depth=3, rounds=10, rate=0.3, least=10)),
    ]
    return trees.candidates(data, [(name, m.fit(data)) for name, m in models], "1 + actual / 50")


@queries.add("stacked_prices")
def stacked_prices(spark: SparkSession, d: str) -> DataFrame:
    """A ridge over the held-out words of a line, a forest and boosted trees."""
    data = binned(spark, d)
    models = [trees.Line(range(len(COLUMNS))).fit(data), trees.Forest(n_trees=6, depth=5, least=10).fit(data), trees.Boosted(depth=3, rounds=10, rate=0.3, least=10).fit(data)]
    return trees.stacked(data, models)[0]
