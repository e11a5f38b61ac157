"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

All stages but the last return the columns that they were given, whatever those are called, with their values; only
``text`` and ``n_chars`` may change, in the line stage. Rows whose doc_id is null or shared with others are rows of
their own in every stage but the near-dedup stage, where a doc_id names one document. An empty table goes through all
stages. Texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, line_dedup, packing, quality, simhash
from gristmill.llm.common import stored, table
from gristmill.llm.tokens import default_tokenizer


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good. Null and empty texts have a score like any other; equal
    texts go or stay together."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the one with the smallest doc_id; a document may be left without text,
    null text stays null, and n_chars, where the table has it, follows a text that has changed."""
    out = line_dedup.reduced(docs)
    length = F.when(F.col("__n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[length.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; rows without doc_id all stay.
    Texts without words are alike, and so one of them stays."""
    return simhash.distinct_documents(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without verbatim passages of the benchmark; null and empty texts have none and stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of fixed capacity: one row for each piece of a document; null and empty texts are the end id
    alone."""
    return packing.pack(docs, default_tokenizer())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("best-fit packing", pack_sequences),
]
#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
