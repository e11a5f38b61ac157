"""The corpus operators as queries over the synthetic tables, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gristmill.llm import (
    bpe,
    collocations,
    decontaminate,
    language,
    license_scan,
    line_dedup,
    media,
    packing,
    quality,
    simhash,
    token_counts,
    url_filter,
    vector_codes,
)
from gristmill.llm.common import table
from gristmill.llm.tokens import default_tokenizer


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_count_report(table(spark, sf_dir, "documents"), default_tokenizer())


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_report(table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), default_tokenizer())


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents by speculation and verification, and the texts that they decode to, as digests."""
    return bpe.bpe_report(table(spark, sf_dir, "documents"), default_tokenizer())


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable vectors, by codebooks that are trained on all of them."""
    return vector_codes.vector_code_report(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases of two to four words over all documents."""
    return collocations.collocation_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_language_id": op2_language_id,
        "op3_license_scan": op3_license_scan,
        "op4_media_columns": op4_media_columns,
        "op5_token_counts": op5_token_counts,
        "op6_url_filter": op6_url_filter,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
        "op11_bpe_encode_decode": op11_bpe_encode_decode,
        "op12_vector_codes": op12_vector_codes,
        "op13_collocations": op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE_SQL,
        "op6_url_filter": url_filter.ORACLE_SQL,
        "op12_vector_codes": vector_codes.ORACLE_SQL,
        "op13_collocations": collocations.ORACLE_SQL,
    }
