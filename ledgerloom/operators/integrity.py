"""Balance checks and rollups of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON, ERROR_ABOVE = 0.01, 1.00


def _money(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("decimal(14,2)")


def statement_checks(statements: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(id, calculated_ending, delta, passed, severity): start + credits - debits against the ending balance.

    Debits count by size, whatever their sign; null amounts count as 0.
    """
    calculated = _money("starting_balance") + _money("total_credits") - F.abs(_money("total_debits"))
    delta = _money("ending_balance") - calculated
    out = statements.select("id", "account_id", calculated.cast("double").alias("calculated_ending"), F.round(delta, 2).cast("double").alias("delta"))
    out = out.withColumn("passed", F.abs("delta") <= epsilon)
    return out.withColumn("severity", F.when(F.col("passed"), F.lit(None)).when(F.abs("delta") > ERROR_ABOVE, "error").otherwise("warning"))


def summary(checks: DataFrame) -> DataFrame:
    """One row: statements checked, with issues, total difference and whether that deserves a warning."""
    out = checks.agg(F.count("*").alias("checked"), F.count_if(~F.col("passed")).alias("with_issues"), F.round(F.coalesce(F.sum(F.when(~F.col("passed"), F.col("delta").cast("decimal(18,2)"))), F.lit(0)), 2).cast("double").alias("total_delta"))
    return out.withColumn("valid", F.col("with_issues") == 0).withColumn("warn_total", F.abs("total_delta") > ERROR_ABOVE)


def totals_against_rows(statements: DataFrame, ledger: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """A statement's printed totals against the sums of its ledger rows, unrounded differences."""
    size = F.abs("amount")
    side = lambda d: F.sum(F.when(F.lower(F.trim("direction")) == d, size).otherwise(F.lit(0)))
    sums = ledger.where("statement_db_id is not null").groupBy(F.col("statement_db_id").alias("id")).agg(side("credit").alias("credits"), side("debit").alias("debits"), F.count("*").alias("rows"))
    out = statements.join(sums, "id")
    dc = F.abs(F.abs(_money("total_credits")) - F.col("credits")).cast("double")
    dd = F.abs(F.abs(_money("total_debits")) - F.col("debits")).cast("double")
    return out.select("id", "rows", dc.alias("credits_difference"), dd.alias("debits_difference"), ((dc <= epsilon) & (dd <= epsilon)).alias("passed"))


def account_rollup(statements: DataFrame) -> DataFrame:
    """One row per account: first start and last end balance by period, sums of credits and debits, period and count."""
    key = F.struct("period_start", "id")
    out = statements.groupBy("account_id").agg(
        F.min_by("starting_balance", key).cast("double").alias("starting_balance"), F.max_by("ending_balance", key).cast("double").alias("ending_balance"),
        F.sum("total_credits").cast("double").alias("total_credits"), F.sum("total_debits").cast("double").alias("total_debits"),
        F.min("period_start").alias("period_start"), F.max_by("period_end", key).alias("period_end"), F.count("*").alias("total_statements"),
    )
    return out


def violations(df: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """(id, path, keyword) of each failed check. checks: path -> (keyword, condition that must hold; null fails)."""
    all_ = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(word).alias("keyword"))) for path, (word, ok) in checks.items()])
    return df.select("id", F.explode(F.array_compact(all_)).alias("v")).select("id", "v.path", "v.keyword")


def anchored_balances(ledger: DataFrame, statements: DataFrame) -> DataFrame:
    """(account_id, ending_balance, starting_balance, total_credits, total_debits, period_start, period_end).

    The latest statement with an ending balance is the anchor; later rows are added to it. Without one
    the end is credits less debits. The start is what makes the balance equation hold. Rows should be
    deduplicated before; accounts without rows are left out.
    """
    anchor = statements.where("ending_balance is not null").groupBy("account_id").agg(F.max_by(F.struct("period_end", "ending_balance"), F.struct("period_end", "id")).alias("a"))
    size = F.abs("amount")
    credit = F.lower(F.trim("direction")) == "credit"
    x = ledger.where("account_id is not null").join(anchor, "account_id", "left")
    signed = F.when(credit, size).otherwise(-size)
    sums = x.groupBy("account_id").agg(
        F.sum(F.when(credit, size).otherwise(F.lit(0))).alias("c"), F.sum(F.when(credit, F.lit(0)).otherwise(size)).alias("d"), F.sum(F.when(F.col("date") > F.col("a.period_end"), signed).otherwise(F.lit(0))).alias("later"),
        F.first("a.ending_balance").alias("known"), F.min("date").alias("period_start"), F.max("date").alias("period_end"),
    )
    end = F.coalesce(F.col("known") + F.col("later"), F.col("c") - F.col("d"))
    return sums.select("account_id", end.cast("double").alias("ending_balance"), (end - F.col("c") + F.col("d")).cast("double").alias("starting_balance"), F.col("c").cast("double").alias("total_credits"), F.col("d").cast("double").alias("total_debits"), "period_start", "period_end")


def running_statement_balances(statements: DataFrame) -> DataFrame:
    """(id, account_id, balance): credits less debits accumulated over an account's statements in order of period.

    An account with a single statement has its printed balance instead. An account's statements are
    summed by day of beginning first, so its window is no longer than the calendar.
    """
    net = _money("total_credits") - F.abs(_money("total_debits"))
    days = statements.groupBy("account_id", "period_start").agg(F.sum(net).alias("net"), F.count("*").alias("k"))
    w = Window.partitionBy("account_id").orderBy("period_start")
    upto = F.sum("net").over(w.rowsBetween(Window.unboundedPreceding, 0))
    many = F.sum("k").over(Window.partitionBy("account_id"))
    days = days.select("account_id", "period_start", upto.alias("upto"), many.alias("many"))
    x = statements.join(days, ["account_id", "period_start"])
    balance = F.when((F.col("many") == 1) & F.col("ending_balance").isNotNull(), F.col("ending_balance")).otherwise(F.col("upto"))
    return x.select("id", "account_id", balance.cast("double").alias("balance"))
