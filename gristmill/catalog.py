"""All queries of the library's own operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.plans import battles, cleaning, columns, combining, correlation, diagnosing, ensembles, exploring, filling, kernels, latents, matches, probes, ranking, reports, scoring, shapes, texts

MODULES = (combining, cleaning, columns, scoring, reports, battles, matches, ranking, correlation, texts, shapes, kernels, latents, ensembles, probes, filling, diagnosing, exploring)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.queries.run.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.queries.sql.items()}
