"""Which of several equal rows or statements stays. Windows are partitioned by the whole key, never by an account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; nulls in a key are equal. Keys may be hot: each keeps one
    row per map task by way of a partial aggregation over structs."""
    cols = df.columns
    best = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(key)]).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return best.select(*[F.col("r")[c].alias(c) for c in cols])


def first_seen(df: DataFrame, seq: str) -> DataFrame:
    """Of rows of equal date, description and amount the first by seq."""
    return one_per_key(df, [F.col("date"), F.col("description"), F.col("amount")], [F.col(seq)])


def most_confident(df: DataFrame, seq: str) -> DataFrame:
    """Of rows of equal statement, date, amount, direction and tidied description the most confident, then the first."""
    tidy = F.regexp_replace(F.lower(F.trim("description")), r"\s+", " ")
    doubt = -F.coalesce("confidence", F.lit(-1.0))
    return one_per_key(df, [F.col("statement_db_id"), F.col("date"), F.col("amount"), F.col("direction"), tidy], [doubt, F.col(seq)])


def latest(df: DataFrame, seq: str) -> DataFrame:
    """Of rows of equal account, date, amount, direction and description the one stored last."""
    return one_per_key(df, [F.col(c) for c in ("account_id", "date", "amount", "direction", "description")], [-F.unix_micros("created_at"), F.col(seq)])


def completeness(transactions: Column) -> Column:
    """How much of a statement was read."""
    has = lambda c, n: F.when(c, n).otherwise(0)
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    out = F.coalesce(transactions, F.lit(0)) * 10
    out += has(F.coalesce("total_credits", F.lit(0)) > 0, 5) + has(F.abs(F.coalesce("total_debits", F.lit(0))) > 0, 5)
    out += has(some("starting_balance") | some("ending_balance"), 3) + has(F.col("period_start").isNotNull() & F.col("period_end").isNotNull(), 5)
    return out


def is_combined(name: Column) -> Column:
    """Whether a file's name says that it holds several statements."""
    return F.lower(name).rlike("combined|merged|all_statements|all-statements|allstatements")


def ranked_statements(df: DataFrame) -> DataFrame:
    """df with rank 1 for the fullest statement of each account and period, then standalone files, then by name and id."""
    w = Window.partitionBy("account_id", "period_start", "period_end").orderBy(F.desc("score"), "combined", "statement_id", "id")
    return df.withColumn("score", completeness(F.col("transaction_count"))).withColumn("combined", is_combined(F.col("statement_id"))).withColumn("rank", F.row_number().over(w))
