"""Reading what collectors leave behind: dated files, odd CSV, JSON conversations, tables inside pages."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import closing
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATED = re.compile(r"(\d{4})-?(\d{2})-?(\d{2})")


def latest(names: Sequence[str]) -> str:
    """The name with the latest date (YYYYMMDD or YYYY-MM-DD); the first of equals; the first if none has a date."""
    if not names:
        raise ValueError("no file matches")
    best, at = sorted(names)[0], ""
    for name in sorted(names):
        m = DATED.search(name.rsplit("/", 1)[-1])
        if m and "".join(m.groups()) > at:
            best, at = name, "".join(m.groups())
    return best


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, with quoted line breaks and doubled quotes; headers without white space around."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
    return raw.toDF(*[c.strip() for c in raw.columns])


def read_roster(spark: SparkSession, path: str, skip: Sequence[str] = ()) -> DataFrame:
    """Model, openbench_id and Reasoning of the models that have an id and are not to be skipped."""
    df = read_csv(spark, path)
    if lost := {"Model", "openbench_id"} - set(df.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(lost))}")
    if "reasoning" in df.columns:
        df = df.withColumnRenamed("reasoning", "Reasoning")
    kept = df.where((F.coalesce(F.trim("openbench_id"), F.lit("")) != "") & ~F.col("Model").isin(list(skip)))
    flag = F.lower(F.trim("Reasoning")).isin("true", "1", "yes") if "Reasoning" in df.columns else F.lit(None).cast("boolean")
    return kept.select("Model", "openbench_id", flag.alias("Reasoning"))


def read_conversations(spark: SparkSession, path: str, shortest: int = 20, longest: int = 50_000) -> DataFrame:
    """Completed conversations from a tree of JSON documents, without those that have a very short or long turn."""
    schema = "model string, scenario_id string, completed boolean, turns array<struct<turn:int,prompt:string,response:string>>"
    docs = spark.read.option("recursiveFileLookup", True).option("multiLine", True).schema(schema).json(path)
    fit = F.forall("turns", lambda t: F.length(F.coalesce(t["response"], F.lit(""))).between(shortest, longest))
    return docs.where(F.col("completed") & fit)


def read_stories(spark: SparkSession, path: str) -> DataFrame:
    """(model, prompt, text) from folder/prompt_*.txt, whole files."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "prompt_*.txt").text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    return texts.select(F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("model"), F.regexp_extract(file, r"([^/]+)\.txt$", 1).alias("prompt"), F.col("value").alias("text"))


class Cells(HTMLParser):
    """Rows of all tables of a page."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self.open = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self.open = False

    def handle_data(self, data: str) -> None:
        if self.open:
            self.rows[-1][-1] += data


def html_rows(html: str | None) -> list[list[str]]:
    parser = Cells()
    parser.feed(html or "")
    return [[c.strip() for c in r] for r in parser.rows if len(r) > 1]


def markdown_rows(text: str | None) -> list[list[str]]:
    """The first pipe table: header and rows of the header's width."""
    out: list[list[str]] = []
    for line in (text or "").split("\n"):
        if line.strip().startswith("|"):
            out.append([c.strip() for c in line.strip().strip("|").split("|")])
        elif out:
            break
    return [r for r in out if len(r) == len(out[0]) and not all(re.fullmatch(r":?-+:?", c) for c in r)]


def table_rows(pages: DataFrame, key: str, column: str, kind: str = "html") -> DataFrame:
    """(key, row, cells) of the tables inside a text column."""
    parse = {"html": html_rows, "markdown": markdown_rows}[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, r) for k, t in zip(f[key], f[column], strict=True) for i, r in enumerate(parse(t))]
            yield pd.DataFrame(rows, columns=[key, "row", "cells"])

    kind_ = pages.schema[key].dataType.simpleString()
    return pages.select(key, column).mapInPandas(run, f"`{key}` {kind_}, row int, cells array<string>")


def embedded_csv(text: str, name: str) -> str | None:
    """The CSV in a script's backtick literal."""
    m = re.search(rf"{re.escape(name)}\s*=\s*`([^`]*)`", text)
    return m[1].strip() if m else None


def wide_from_json(df: DataFrame, key: str, column: str) -> DataFrame:
    """Maps of changing keys as columns, the sorted union of all keys."""
    cells = df.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("k", "v"))
    return cells.groupBy(key).pivot("k").agg(F.first("v"))


ENCODINGS = ("UTF-8", "ISO-8859-1")


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if every byte of the files is, else ISO-8859-1, which takes any byte. The test runs inside the engine."""
    raw = spark.read.format("binaryFile").load(path)
    odd = raw.where(~F.is_valid_utf8(F.col("content").cast("string")))
    return ENCODINGS[0] if odd.isEmpty() else ENCODINGS[1]


def read_csv_any(spark: SparkSession, path: str) -> DataFrame:
    """``read_csv`` in the encoding that the files have, without a byte order mark in the first name."""
    df = read_csv(spark, path, encoding_of(spark, path))
    return df.toDF(*[c.removeprefix("﻿").removeprefix("ï»¿").strip('" ') for c in df.columns])


def first_readable(spark: SparkSession, paths: Sequence[str], read: Callable[[SparkSession, str], DataFrame] = read_csv) -> tuple[str, DataFrame]:
    """The first of the places that can be read, and what is there: how a roster is located."""
    for path in paths:
        try:
            return path, read(spark, path)
        except AnalysisException:
            continue
    raise FileNotFoundError(f"none of {', '.join(paths)}")


def newest(spark: SparkSession, root: str, name: str) -> str | None:
    """The path of the file of that name below ``root`` that changed last; of equals the greatest path; None without any."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    except AnalysisException:
        return None
    row = files.select("path", "modificationTime").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return row["p"]


def read_name_maps(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(source, name, mapped) of JSON objects from names to names; what is missing or no such object gives no rows."""
    out = spark.createDataFrame([], "source string, name string, mapped string")
    for path in paths:
        try:
            text = spark.read.text(path, wholetext=True)
        except AnalysisException:
            continue
        pairs = text.select(F.regexp_extract(F.col("_metadata.file_name"), r"(.*?)(\.json)?$", 1).alias("source"), F.explode(F.from_json("value", "map<string,string>")).alias("name", "mapped"))
        out = out.unionByName(pairs)
    return out


def read_responses(spark: SparkSession, path: str, without: Sequence[str] = ()) -> DataFrame:
    """model_name, question_id, response: the first good run of each model and question, questions left out aside."""
    df = read_csv(spark, path).where("status = 'ok'").where(~F.col("question_id").isin(list(without)))
    return df.groupBy("model_name", "question_id").agg(F.min_by("response", F.col("run").try_cast("int")).alias("response"))


def unified_corpora(parts: Mapping[str, tuple[DataFrame, Mapping[str, str]]], clean: Callable[[Column], Column]) -> DataFrame:
    """bench, model, key, text of differently shaped sources: for each its frame and what its columns are called
    ('model', 'key' and 'text' by own names). Texts are cleaned; empty ones drop out."""
    out = None
    for bench, (df, names) in parts.items():
        own = df.select(F.lit(bench).alias("bench"), *[F.col(names[c]).cast("string").alias(c) for c in ("model", "key")], clean(F.col(names["text"])).alias("text"))
        out = own if out is None else out.unionByName(own)
    return out.where(F.length("text") > 0)


def completed(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema in its order and types; those that are missing are null, others go."""
    want = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def scenarios(spark: SparkSession, path: str, ids: Sequence[int] | None = None) -> DataFrame:
    """id, category, title, prompts of scenario files: heads are lines '######## id | category | title', prompts stand
    under '####### PromptN'. Text operations of the engine throughout; empty prompts drop out."""
    text = spark.read.text(path, wholetext=True).select(F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("t"))
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.col("t")), r"\n(?=######## \d+ *\|)"), 2, 1_000_000)
    one = text.select(F.explode(parts).alias("p"))
    head = r"^######## (\d+)\s*\|\s*([^|\n]+?)\s*\|\s*([^\n]+?)\s*(?:\n|$)"
    prompts = F.slice(F.split(F.col("p"), r"(?m)^####### Prompt\d+[ \t]*$"), 2, 1_000_000)
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    out = one.select(
        F.regexp_extract("p", head, 1).try_cast("int").alias("id"), F.regexp_extract("p", head, 2).alias("category"), F.regexp_extract("p", head, 3).alias("title"),
        F.filter(F.transform(prompts, strip), lambda x: x != "").alias("prompts"),
    ).where("id is not null")
    return out if ids is None else out.where(F.col("id").isin(list(ids)))


def prompt_elements(spark: SparkSession, path: str, end: str = "sentence.") -> DataFrame:
    """id, template, elements of prompt files: the template ends with ``end``, an empty line follows, then 'Key: value'
    lines, whose keys become lower case with underscores."""
    text = spark.read.text(path, wholetext=True)
    cut = F.split(F.replace("value", F.lit("\r\n"), F.lit("\n")), re.escape(end) + r"\n\n", 2)
    lines = F.filter(F.split(F.get(cut, F.lit(1)), "\n"), lambda x: F.contains(x, F.lit(":")))
    key = lambda x: F.replace(F.lower(F.trim(F.substring_index(x, ":", 1))), F.lit(" "), F.lit("_"))
    value = lambda x: F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x)))
    entries = F.map_from_entries(F.transform(lines, lambda x: F.struct(key(x), value(x))))
    name = F.regexp_extract(F.col("_metadata.file_name"), r"(?:prompt_)?([^.]*)", 1)
    return text.select(name.alias("id"), F.concat(F.get(cut, F.lit(0)), F.lit(end)).alias("template"), entries.alias("elements")).where("elements is not null")


def sqlite_rows(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """The rows of a query in each of the SQLite files: files are spread over the tasks, opened from memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                with closing(sqlite3.connect(":memory:")) as db:
                    db.deserialize(bytes(content))
                    yield pd.DataFrame(db.execute(query).fetchall(), columns=names)

    names = spark.createDataFrame([], schema).columns
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def csv_in_script(pages: DataFrame, key: str, column: str, name: str, schema: str) -> DataFrame:
    """The rows of the CSV that a script holds in a backtick literal of this name, for each page."""
    body = F.regexp_extract(column, rf"{re.escape(name)}\s*=\s*`([^`]*)`", 1)
    lines = pages.select(key, F.posexplode(F.split(F.regexp_replace(body, r"^\s+|\s+$", ""), r"\r?\n")).alias("row", "line")).where("row > 0 and line != ''")
    return lines.select(key, F.from_csv("line", schema).alias("r")).select(key, "r.*")
