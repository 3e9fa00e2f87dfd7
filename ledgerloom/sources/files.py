"""Folders of statement files, and lines and tokens of their pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tokens whose baselines differ less stand in one row; a gap of half a character's width is a blank.
ROW_TOLERANCE = 3.0
TAB_GAP, BLANK_GAP = 18.0, 2.5


def statement_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length, skipped) of the folder's PDF files, not below it, in order of name.

    Temporary and hidden files and empty ones are marked with the reason they are skipped. Only the
    folder is listed, as a scan would do itself (which leaves out empty files); contents are not read. A
    folder without such files gives no rows, a missing folder an error.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    rows = sorted((f.getPath().getName(), f.getPath().toString(), f.getLen()) for f in found if f.isFile())
    rows = [(p, n, size) for n, p, size in rows if n.lower().endswith(".pdf")]
    name = F.col("name")
    reason = F.when(F.startswith(name, F.lit("~$")) | F.startswith(name, F.lit(".")), "temporary").when(F.col("length") == 0, "empty")
    return spark.createDataFrame(rows, "path string, name string, length bigint").withColumn("skipped", reason)


def folder_problem(spark: SparkSession, folder: str) -> str | None:
    """Why a folder cannot be scanned: missing, no folder, or not readable; None if it can."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return "missing"
    if not fs.getFileStatus(path).isDirectory():
        return "no folder"
    try:
        fs.access(path, jvm.org.apache.hadoop.fs.permission.FsAction.READ_EXECUTE)
    except Exception:  # noqa: BLE001  the file system says no in its own way
        return "not readable"
    return None


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, page, line_index, line) of extracted text files, pages set apart by a form feed."""
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    pages = files.select("file", F.posexplode(F.split("value", "\f")).alias("page", "text"))
    lines = pages.select("file", (F.col("page") + 1).alias("page"), F.posexplode(F.split("text", r"\r?\n")).alias("line_index", "line"))
    return lines


def matching_lines(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.where(F.col("line").rlike(pattern))


def between_markers(text: Column, start: str, end: str) -> Column:
    """The text between two markers, to its end if the second is missing; empty without the first."""
    rest = F.when(F.contains(text, F.lit(start)), F.substring_index(F.substring(text, F.instr(text, start) + F.lit(len(start)), F.length(text)), end, 1))
    return F.coalesce(rest, F.lit(""))


def page_text(lines: DataFrame) -> DataFrame:
    """(file, page, text): each page's lines in their order; a page is bounded by its size."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_index", "line"))), lambda x: x["line"])
    return lines.groupBy("file", "page").agg(F.array_join(ordered, "\n").alias("text"))


def document_text(lines: DataFrame) -> DataFrame:
    """(file, pages, text): each file's pages one after the other, set apart by a line break; a file is bounded by its size."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return page_text(lines).groupBy("file").agg(F.max("page").alias("pages"), F.array_join(ordered, "\n").alias("text"))


# ---- tokens with positions ----

TOKEN_ROWS = "file string, page int, row int, y double, text string, items array<struct<str:string,x:double,width:double>>"


def token_rows(tokens: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """(file, page, row, y, text, items) from tokens (file, page, str, x, y, width), top row first.

    A row begins with a token that lies further than the tolerance below the row's first token; this
    anchor makes it a fold over a page, so each page is handled by itself.
    """

    def rows(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y", "x"], ascending=[False, True], kind="stable")
        out: list[list] = []
        for t in page.itertuples():
            if not out or abs(t.y - out[-1][0].y) > tolerance:
                out.append([])
            out[-1].append(t)
        made = []
        for i, row in enumerate(out):
            row = sorted(row, key=lambda t: t.x)
            made.append((page["file"].iloc[0], page["page"].iloc[0], i, sum(t.y for t in row) / len(row), joined(row), [{"str": t.str, "x": t.x, "width": t.width} for t in row]))
        return pd.DataFrame(made, columns=["file", "page", "row", "y", "text", "items"])

    return tokens.groupBy("file", "page").applyInPandas(rows, TOKEN_ROWS)


def joined(row: list) -> str:
    """Tokens from left to right, with a blank where the gap is wider than half a character."""
    text = row[0].str
    for a, b in zip(row, row[1:]):
        text += " " * (b.x - a.x - a.width > 0.5 * a.width / max(len(a.str), 1)) + b.str
    return text


def wrapped_rows(rows: DataFrame, date_pattern: str = r"^\s*\d{2}/\d{2}(?:/\d{2,4})?") -> DataFrame:
    """Rows with those that do not begin with a date appended to the dated row above; rows before any date stay."""
    w = Window.partitionBy("file", "page").orderBy("row")
    dated = F.col("text").rlike(date_pattern)
    marked = rows.withColumn("g", F.sum(dated.cast("int")).over(w)).withColumn("g", F.when(F.col("g") == 0, -F.col("row") - 1).otherwise(F.col("g")))
    parts = F.array_sort(F.collect_list(F.struct("row", "text")))
    out = marked.groupBy("file", "page", "g").agg(F.min("row").alias("row"), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))
    return out.select("file", "page", "row", "text")


def header_columns(header: DataFrame, page_width: float = 612.0) -> DataFrame:
    """(file, page, name, left, right) from tokens of a header row: a column ends where the next begins."""
    w = Window.partitionBy("file", "page").orderBy("x")
    right = F.coalesce(F.lead("x").over(w) - 1, F.lit(page_width))
    return header.select("file", "page", F.lower(F.trim("str")).alias("name"), F.col("x").alias("left"), right.alias("right"))


def clustered_columns(tokens: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """(file, page, left, tokens): columns of a page by single-link clusters of the tokens' left edges."""
    w = Window.partitionBy("file", "page").orderBy("x")
    gap = F.coalesce(F.col("x") - F.lag("x").over(w) > tolerance, F.lit(True))
    c = tokens.withColumn("c", F.sum(gap.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("file", "page", "c").agg(F.min("x").alias("left"), F.count("*").alias("tokens")).drop("c")


def in_columns(tokens: DataFrame, columns: DataFrame) -> DataFrame:
    """Tokens with the name of the column they begin in."""
    hit = (tokens["file"] == columns["file"]) & (tokens["page"] == columns["page"]) & (tokens["x"] >= columns["left"]) & (tokens["x"] < columns["right"])
    return tokens.join(columns, hit, "left").select(tokens["*"], columns["name"].alias("column"))


def tokens_to_lines(tokens: Iterator) -> list[str]:
    """Lines of one page from (str, x, y, width) tuples: wide gaps are tabs, narrower ones blanks."""
    rows: list[list[tuple]] = []
    for t in sorted(tokens, key=lambda t: (-t[2], t[1])):
        if not rows or abs(t[2] - rows[-1][0][2]) > 2.0:
            rows.append([])
        rows[-1].append(t)
    out = []
    for row in rows:
        row.sort(key=lambda t: t[1])
        line = row[0][0]
        for a, b in zip(row, row[1:]):
            gap = b[1] - a[1] - a[3]
            line += ("\t" if gap > TAB_GAP else " " if gap > BLANK_GAP else "") + b[0]
        out.append(line)
    return out
