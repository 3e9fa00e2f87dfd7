"""Parsers of statement files under names, so that further kinds of files can be added from outside.

A parser tells from a file's text whether the file is of its kind, and makes rows from lines. A file
belongs to the first parser, in the order in which they were added, that knows it; files are told apart
in one plan, and each parser reads its own files only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources import batch, files
from ledgerloom.sources import statement_lines as sl

ROWS = "file string, page int, line_index int, date date, description string, amount double, original_text string"


@dataclass(frozen=True)
class Parser:
    """detect: a condition on a file's text. parse: lines (file, page, line_index, line) to rows as in ROWS."""

    detect: Callable[[Column], Column]
    parse: Callable[[DataFrame], DataFrame]


_parsers: dict[str, Parser] = {}


def add(name: str, detect: Callable[[Column], Column], parse: Callable[[DataFrame], DataFrame]) -> None:
    """Add a parser, or put it in the place of the one of that name."""
    _parsers[name] = Parser(detect, parse)


def remove(name: str) -> None:
    _parsers.pop(name, None)


def names() -> list[str]:
    return list(_parsers)


def detected(lines: DataFrame) -> DataFrame:
    """(file, parser): null for files that no parser knows."""
    text = files.page_text(lines).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("text"))  # a file's pages
    known = F.coalesce(*[F.when(F.coalesce(p.detect(F.col("text")), F.lit(False)), F.lit(n)) for n, p in _parsers.items()], F.lit(None).cast("string"))
    return text.select("file", known.alias("parser"))


def parsed(lines: DataFrame) -> DataFrame:
    """ROWS and parser of all files that a parser knows."""
    kinds = detected(lines)
    out = lines.sparkSession.createDataFrame([], ROWS + ", parser string")
    for name, p in _parsers.items():
        own = lines.join(kinds.where(F.col("parser") == name).select("file"), "file", "left_semi")
        out = out.unionByName(p.parse(own).select(*[c.split()[0] for c in ROWS.split(", ")]).withColumn("parser", F.lit(name)))
    return out


def _statement_rows(lines: DataFrame) -> DataFrame:
    rows = batch.parsed(lines)[1]
    return rows.withColumn("file", F.col("source"))


add("details", sl.is_details, sl.details_rows)
add("statement", lambda text: sl.account_kind(text) != "unknown", _statement_rows)
