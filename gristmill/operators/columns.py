"""Rules on columns and names: which to keep, what they are called, what they are made of."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = ("byte", "short", "int", "bigint", "smallint", "tinyint", "float", "double", "decimal")


def whitelisted(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Those of the wanted columns that there are, in the order wanted, and the names of the others. Without any the
    frame has neither columns nor rows."""
    there = [c for c in wanted if c in df.columns]
    out = df.select(*[F.col(f"`{c}`") for c in there])
    return (out if there else out.limit(0)), [c for c in wanted if c not in df.columns]


def name_column(df: DataFrame, candidates: Sequence[str], part: str = "Model") -> str | None:
    """The first candidate with any value, else the first column whose name has ``part``; None if there is neither."""
    there = [c for c in candidates if c in df.columns]
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(there)]).first() if there else ()
    for c, n in zip(there, filled, strict=True):
        if n:
            return c
    return next((c for c in df.columns if part.lower() in c.lower()), None)


def numeric_columns(df: DataFrame, without: Sequence[str] = (), exempt: Sequence[str] = (), also_without: Sequence[str] = ()) -> list[str]:
    """Numeric columns, minus those whose name has one of the parts ``without`` (but for exempt ones) and those named."""
    kinds = [c for c, t in df.dtypes if t.startswith(NUMERIC)]
    return [c for c in kinds if c not in also_without and (c in exempt or not any(p in c for p in without))]


def without_families(columns: Iterable[str], prefixes: Sequence[str], names: Sequence[str] = ()) -> list[str]:
    return [c for c in columns if not c.startswith(tuple(prefixes)) and c not in names]


def split_by_prefix(columns: Iterable[str], prefixes: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns with one of the prefixes, and the others."""
    own = [c for c in columns if c.startswith(tuple(prefixes))]
    return own, [c for c in columns if c not in own]


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with more than one value and a variance above 0: one aggregation for all."""
    row = df.agg(*[x.alias(f"{n}{i}") for i, c in enumerate(columns) for n, x in (("d", F.count_distinct(c)), ("v", F.variance(c)))]).first()
    return [c for i, c in enumerate(columns) if row[f"d{i}"] > 1 and (row[f"v{i}"] or 0) > 0]


def find_column(columns: Sequence[str], wanted: str) -> str:
    """The column of that name; else of that name without white space around, in any case; else the one that has it
    as a part. An error if there is none or more than one."""
    tests = (lambda c: c == wanted, lambda c: c.strip() == wanted.strip(), lambda c: c.strip().lower() == wanted.strip().lower(), lambda c: wanted.strip().lower() in c.lower())
    for test in tests:
        found = [c for c in columns if test(c)]
        if len(found) == 1:
            return found[0]
        if found:
            raise ValueError(f"{wanted!r} may be any of {', '.join(found)}")
    raise ValueError(f"no column {wanted!r}")


def first_prefix(name: Column, prefixes: Sequence[str], other: str = "other") -> Column:
    """The first of the prefixes that a name has, in the order given."""
    out = F.lit(other)
    for p in reversed(prefixes):
        out = F.when(F.lower(name).startswith(p.lower()), p).otherwise(out)
    return out


def first_part(name: Column, parts: Mapping[str, str], other: str = "Other") -> Column:
    """The label of the first part that a name has anywhere, in any case."""
    out = F.lit(other)
    for part, label in reversed(list(parts.items())):
        out = F.when(F.contains(F.lower(name), F.lit(part.lower())), label).otherwise(out)
    return out


def interaction(name: str) -> tuple[list[str], str]:
    """The columns that a derived feature is made of and its kind: 'A*B' product, 'A^2' square, else the column itself."""
    if m := re.fullmatch(r"(.+)\^2", name):
        return [m[1]], "square"
    parts = name.split("*")
    return (parts, "product") if len(parts) == 2 and all(parts) else ([name], "plain")


def last_by_key(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The last row of each key in the order given."""
    w = Window.partitionBy("__key").orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__key", key).withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place", "__key")
