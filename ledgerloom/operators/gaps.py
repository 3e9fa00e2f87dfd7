"""Filling days that statements leave open from a feed, and remembering what was looked for in vain.

Tables: ranges that are known (account, start, end), a cache of checked ranges (account, start, end,
checked_at) and the first day of each feed account. All are joined by account; nothing is kept in a
session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.coverage import rows_in_gaps, uncovered


def mark_checked(cache: DataFrame, ranges: DataFrame, at: Column) -> DataFrame:
    """The cache with further ranges (account, gap_start, gap_end); one that it has already keeps its time."""
    new = ranges.select("account", F.col("gap_start").alias("start"), F.col("gap_end").alias("end")).distinct().join(cache, ["account", "start", "end"], "left_anti")
    return cache.unionByName(new.withColumn("checked_at", at))


def remember_earliest(known: DataFrame, found: DataFrame) -> DataFrame:
    """(feed_account, earliest): what was found last replaces what was known."""
    both = known.select("feed_account", "earliest", F.lit(0).alias("new")).unionByName(found.select("feed_account", "earliest", F.lit(1).alias("new")))
    return both.groupBy("feed_account").agg(F.max_by("earliest", "new").alias("earliest"))


def open_gaps(known: DataFrame, cache: DataFrame, first: Column, last: Column) -> DataFrame:
    """(account, gap_start, gap_end): days between first and last that neither a known nor a checked range covers."""
    both = known.select("account", "start", "end").unionByName(cache.select("account", "start", "end"))
    return uncovered(both, "account", "start", "end", first, last)


def clamped(gaps: DataFrame, earliest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to_fetch, checked): gaps from the feed's first day on, and what lies before it and needs no fetch.

    earliest: (account, earliest); a gap of an account without one is fetched whole.
    """
    x = gaps.join(earliest.groupBy("account").agg(F.min("earliest").alias("earliest")), "account", "left")
    fetch = x.where(F.col("earliest").isNull() | (F.col("gap_end") >= F.col("earliest"))).select("account", F.greatest("gap_start", F.coalesce("earliest", "gap_start")).alias("gap_start"), "gap_end")
    before = x.where(F.col("gap_start") < F.col("earliest")).select("account", "gap_start", F.least("gap_end", F.date_sub("earliest", 1)).alias("gap_end"))
    return fetch, before


def filled(to_fetch: DataFrame, feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, empty): the feed rows (account, date) that fall into gaps, and the gaps that none fell into.

    Both are found by month, so no account's rows meet all of its gaps.
    """
    rows = rows_in_gaps(feed, "account", "date", to_fetch)
    months = F.explode(F.sequence(F.trunc("gap_start", "month"), F.trunc("gap_end", "month"), F.expr("interval 1 month"))).alias("m")
    days = rows.groupBy("account", F.trunc("date", "month").alias("m")).agg(F.min("date").alias("a"), F.max("date").alias("b"), F.collect_set("date").alias("days"))  # 31 at most
    met = to_fetch.select("account", "gap_start", "gap_end", months).join(days, ["account", "m"]).where(F.exists("days", lambda d: d.between(F.col("gap_start"), F.col("gap_end"))))
    return rows, to_fetch.join(met.select("account", "gap_start", "gap_end").distinct(), ["account", "gap_start", "gap_end"], "left_anti")


def uploaded(rows: DataFrame, stored: DataFrame, key: Column, user: Column) -> DataFrame:
    """Feed rows as new ledger rows, but for those whose key is stored: amounts by size, direction by sign, the feed's name as text."""
    new = rows.withColumn("transaction_id", key).join(stored.select("transaction_id").distinct(), "transaction_id", "left_anti")
    debit = F.col("amount") > 0
    return new.select(
        user.alias("user_id"), F.col("account").alias("account_id"), "transaction_id", "date", F.coalesce("authorized_date", "date").alias("posted_date"), F.when(debit, -F.abs("amount")).otherwise(F.abs("amount")).alias("amount"),
        F.when(debit, "debit").otherwise("credit").alias("direction"), F.col("name").alias("description"), F.coalesce("merchant_name", "name").alias("merchant"),
    )
