"""Folders of statement files from lines to statements, rows and errors: one plan over all files.

A file may hold several statements; each begins at the period printed before its beginning balance. What
cannot be read is a row of an error table, so one bad file never stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources import statement_lines as sl

#: How far before its beginning balance a statement's period may be printed, in characters.
LOOK_BACK = 500
BEGINS = rf"(?i)Beginning\s+balance\s+on\s+{sl._DAY}"
PERIOD = rf"(?i)(?:for\s+)?{sl._DAY}\s+to\s+{sl._DAY}"
# Errors that tell a file of another kind from a broken one.
FOREIGN = ("Failed to parse any statements", "Unable to detect account type", "No transactions found")
PART = "#"


def segments(lines: DataFrame) -> DataFrame:
    """Lines with file, part and source: a part for each statement of the source file, named source#1, source#2, ...

    A part runs from the first period printed within LOOK_BACK characters before a beginning balance (or
    from that balance) to where the next one begins; what stands before the first belongs to none. A file
    without a dated beginning balance is one part.
    """
    order = Window.partitionBy("file").orderBy("page", "line_index")
    x = lines.withColumn("at", F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("line") - 1)
    at = lambda p: F.when(F.col("line").rlike(p), F.col("at") + F.regexp_instr("line", F.lit(p)) - 1)
    x = x.withColumn("begins", at(BEGINS)).withColumn("period", at(PERIOD))
    x = x.withColumn("next", F.first("begins", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    # The balance that a printed period leads to, and of the periods that lead to one balance the first.
    leads = x.withColumn("to", F.coalesce("begins", F.when((F.col("period") < F.col("next")) & (F.col("next") - F.col("period") <= LOOK_BACK), F.col("next"))))
    first = F.row_number().over(Window.partitionBy("file", "to").orderBy("page", "line_index")) == 1
    leads = leads.withColumn("opens", F.col("to").isNotNull() & first)
    numbered = leads.withColumn("part", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = numbered.withColumn("any", F.max("opens").over(Window.partitionBy("file")))
    kept = numbered.where((F.col("part") > 0) | ~F.col("any")).withColumn("part", F.greatest("part", F.lit(1)))
    return kept.select(F.concat_ws(PART, "file", F.col("part").cast("string")).alias("file"), "page", "line_index", "line", "part", F.col("file").alias("source"))


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements, rows) of files with one or more statements each; both carry source and part.

    Only rows within their statement's period count, and totals are always reckoned from rows, since
    printed ones may stand in another part. A credit card's file is one statement.
    """
    whole = sl.headers(lines).select("file", "kind")
    parts = segments(lines.join(whole.where("kind != 'credit'").select("file"), "file", "left_semi"))
    cards = lines.join(whole.where("kind = 'credit'").select("file"), "file", "left_semi").select(F.concat_ws(PART, "file", F.lit("1")).alias("file"), "page", "line_index", "line", F.lit(1).alias("part"), F.col("file").alias("source"))
    both = parts.unionByName(cards)
    head = sl.headers(both)
    rows = sl.within_period(sl.transactions(both.drop("part", "source"), head), head)
    cents = lambda sign: F.coalesce(F.sum(F.when(F.col("amount") * sign > 0, F.abs("amount").cast("decimal(14,2)"))), F.lit(0)).cast("double")
    sums = rows.groupBy("file").agg(F.count("*").alias("transaction_count"), cents(1).alias("credits"), cents(-1).alias("debits"))
    # Of cards payments are negative: what lowers the debt is a credit.
    card = F.col("kind") == "credit"
    out = head.drop("total_credits", "total_debits").join(sums, "file", "left").withColumns({
        "transaction_count": F.coalesce("transaction_count", F.lit(0)),
        "total_credits": F.coalesce(F.when(card, F.col("debits")).otherwise(F.col("credits")), F.lit(0.0)),
        "total_debits": F.coalesce(F.when(card, F.col("credits")).otherwise(F.col("debits")), F.lit(0.0)),
    }).drop("credits", "debits")
    from_ = both.select("file", "source", "part").distinct()
    return out.join(from_, "file"), rows.join(from_, "file")


def batch(lines: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statements, rows, errors) of a batch: files (name, skipped) as sources.files lists them, lines of those that could be read.

    errors: (file, error) of files that were skipped, have no text, no statement or no row.
    """
    statements, rows = parsed(lines)
    text = lines.groupBy("file").agg(F.max(F.length(F.trim("line"))).alias("longest"))
    found = statements.groupBy(F.col("source").alias("file")).agg(F.count("*").alias("statements"), F.sum("transaction_count").alias("rows"))
    x = files.select(F.col("name").alias("file"), "skipped").join(text, "file", "left").join(found, "file", "left")
    error = (
        F.when(F.col("skipped").isNotNull(), F.concat(F.lit("File skipped: "), "skipped")).when(F.coalesce("longest", F.lit(0)) == 0, "No text could be read")
        .when(F.coalesce("statements", F.lit(0)) == 0, "Failed to parse any statements").when(F.coalesce("rows", F.lit(0)) == 0, "No transactions found in the file's statements")
    )
    return statements, rows, x.withColumn("error", error).where("error is not null").select("file", "error")


def is_foreign(error: Column) -> Column:
    """Whether an error says that a file is of another kind."""
    out = F.lit(False)
    for text in FOREIGN:
        out |= F.contains(F.lower(error), F.lit(text.lower()))
    return F.coalesce(out, F.lit(False))


def batch_summary(files: DataFrame, statements: DataFrame, errors: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """One row: files found, read and failed, statements before and after deduplication (kept; all if none is given)."""
    one = F.lit(1).alias("one")
    n = lambda df, name: df.agg(F.count("*").alias(name)).select(one, name)
    out = n(files, "files_found").join(n(errors, "files_failed"), "one").join(n(statements, "statements_found"), "one").join(n(kept if kept is not None else statements, "statements_kept"), "one")
    return out.select("files_found", (F.col("files_found") - F.col("files_failed")).alias("files_read"), "files_failed", "statements_found", (F.col("statements_found") - F.col("statements_kept")).alias("duplicates_removed"))
