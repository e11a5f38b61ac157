"""Rows out of web pages: tables with rules on their cells, and arrays of records in streamed script payloads."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

PUSHED = re.compile(r"__next_f\.push\(\s*(\[.*?\])\s*\)\s*(?:;|</script>|$)", re.DOTALL)
SCRIPT = re.compile(r"<script[^>]*>(.*?)</script>", re.DOTALL | re.IGNORECASE)
DEEPEST = 20


class Table(HTMLParser):
    """The rows of a page's tables; of each cell its text and the classes of what stands in it."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[tuple[str, set[str]]]] = []
        self.text: list[str] | None = None
        self.classes: set[str] = set()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.text, self.classes = [], set()
        if self.text is not None:
            self.classes |= set((dict(attrs).get("class") or "").split())

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data.strip())

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.text is not None:
            self.rows[-1].append((" ".join(t for t in self.text if t), self.classes))
            self.text = None


def marked_rows(html: str | None, mark: str, unless: str, suffix: str) -> list[list[str]]:
    """Header and rows of its width. A first cell with an element of class ``mark`` and none of class ``unless`` gets
    the suffix, which tells two versions of a model apart."""
    parser = Table()
    parser.feed(html or "")
    rows = [r for r in parser.rows if r]
    if not rows:
        return []
    out = [[t for t, _ in rows[0]]]
    for row in rows[1:]:
        if len(row) == len(out[0]):
            name, classes = row[0]
            out.append([f"{name}{suffix}" if mark in classes and unless not in classes else name, *[t for t, _ in row[1:]]])
    return out


def values(html: str) -> Iterator[object]:
    """All JSON values that a page's scripts hold: pushed payloads line by line behind their numbers, then script bodies."""
    decode = json.JSONDecoder()
    pushed = []
    for body in PUSHED.findall(html):
        try:
            pushed += [x for x in json.loads(body) if isinstance(x, str)]
        except ValueError:
            continue
    for line in "".join(pushed).split("\n"):  # a line may go on in the next push
        if m := re.match(r"\s*(?:[0-9a-z]{1,9}:)?\s*(?=[\[{])", line):
            try:
                yield decode.raw_decode(line, m.end())[0]
            except ValueError:
                continue
    for body in SCRIPT.findall(html):
        for m in re.finditer(r"[\[{]", body):
            try:
                yield decode.raw_decode(body, m.start())[0]
                break
            except ValueError:
                continue


def largest_array(roots: Iterator[object], keys: Sequence[str]) -> list[dict]:
    """The longest list of records that all have these keys, at most DEEPEST levels down; the first of equals."""
    best: list[dict] = []
    for root in roots:
        level = [root]
        for _ in range(DEEPEST):
            below: list[object] = []
            for x in level:
                if isinstance(x, list):
                    records = [r for r in x if isinstance(r, dict) and all(k in r for k in keys)]
                    best = records if len(records) > len(best) else best
                    below += x
                elif isinstance(x, dict):
                    below += x.values()
            level = below
    return best


def records(pages: DataFrame, key: str, column: str, keys: Sequence[str]) -> DataFrame:
    """(key, place, record): the records of each page as JSON texts, for ``from_json`` with a schema. Pages without
    any have no rows; broken scripts are passed over."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, json.dumps(r, ensure_ascii=False)) for k, t in zip(f[key], f[column], strict=True) if isinstance(t, str) for i, r in enumerate(largest_array(values(t), keys))]
            yield pd.DataFrame(rows, columns=[key, "place", "record"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, column).mapInPandas(run, f"`{key}` {kind}, place int, record string")


def marked_tables(pages: DataFrame, key: str, column: str, mark: str, unless: str, suffix: str = " (Reasoning)") -> DataFrame:
    """(key, row, cells) of pages' tables under the rule of ``marked_rows``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, r) for k, t in zip(f[key], f[column], strict=True) for i, r in enumerate(marked_rows(t, mark, unless, suffix))]
            yield pd.DataFrame(rows, columns=[key, "row", "cells"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, column).mapInPandas(run, f"`{key}` {kind}, row int, cells array<string>")
