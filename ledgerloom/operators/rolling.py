"""Trailing totals over calendar days by block decomposition.

The days of an entity are cut into blocks as long as the window. The trailing total of a day is the
prefix sum of its own block plus the suffix sum of the block before, taken from the day after the
same offset: one addition per day, whatever the window's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_grid(df: DataFrame, entity: str, day: str, cents: Column) -> DataFrame:
    """(entity, day, cents, n) for every day from an entity's first to its last, 0 where nothing happened.

    Equal days are summed before the shuffle by entity, so an entity that holds a third of all rows
    still brings only one row per calendar day and map task. Each active day then fills the days up to
    the next active one; no join is needed. Rows without entity or day are left out, a null amount
    counts as a row of 0.
    """
    active = (
        df.select(F.col(entity).alias("e"), F.col(day).cast("date").alias("d"), cents.alias("c"))
        .where(F.col("e").isNotNull() & F.col("d").isNotNull())
        .groupBy("e", "d")
        .agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("c"), F.count("*").alias("n"))
    )
    nxt = F.lead("d").over(Window.partitionBy("e").orderBy("d"))
    spans = active.withColumn("to", F.coalesce(F.date_sub(nxt, 1), F.col("d")))
    grid = spans.select("e", F.col("d").alias("at"), "c", "n", F.explode(F.sequence("d", "to")).alias("d"))
    first = F.col("d") == F.col("at")
    return grid.select("e", "d", F.when(first, F.col("c")).otherwise(F.lit(0)).alias("c"), F.when(first, F.col("n")).otherwise(F.lit(0)).alias("n"))


def trailing(df: DataFrame, entity: str, day: str, amount: Column, lengths: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(entity, day, amount_day, rows_day, then total_L, avg_L, rows_L for each length L).

    Totals are exact decimals over the L calendar days that end with the day, days before the entity's
    first count as empty and the average always divides by L. The grid is partitioned by entity once;
    all windows reuse that partitioning.
    """
    grid = daily_grid(df, entity, day, (amount * 100).cast("bigint"))
    number = F.datediff("d", F.lit("1970-01-01").cast("date"))
    out = grid
    for n in lengths:
        out = out.withColumn(f"b{n}", F.floor(number / n))
        block = Window.partitionBy("e", f"b{n}").orderBy("d")
        upto, onward = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(0, Window.unboundedFollowing)
        for c in ("c", "n"):
            out = out.withColumn(f"pre_{c}{n}", F.sum(c).over(upto)).withColumn(f"suf_{c}{n}", F.sum(c).over(onward))
    days = Window.partitionBy("e").orderBy("d")
    picked = [F.col("e").alias(entity), F.col("d").alias(day), (F.col("c") / F.lit(100)).cast("decimal(20,2)").alias("amount_day"), F.col("n").alias("rows_day")]
    for n in lengths:
        # The row n-1 days back opens the window; it adds its block's rest unless it begins this block.
        whole = F.pmod(number, F.lit(n)) == n - 1
        total = {c: F.col(f"pre_{c}{n}") + F.when(whole, F.lit(0)).otherwise(F.coalesce(F.lag(f"suf_{c}{n}", n - 1).over(days), _older(c, n, days))) for c in ("c", "n")}
        picked += [
            (total["c"].cast("decimal(20,0)") / 100).cast("decimal(20,2)").alias(f"total_{n}"),
            F.round(total["c"].cast("decimal(20,0)") / (100 * n), 6).cast("decimal(24,6)").alias(f"avg_{n}"),
            total["n"].alias(f"rows_{n}"),
        ]
    return out.select(*picked)


def _older(c: str, n: int, days) -> Column:
    """Where the entity begins after the window's first day: all it has in the block before, if it has days there."""
    all_before = days.rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.first(f"b{n}").over(all_before) < F.col(f"b{n}"), F.first(f"suf_{c}{n}").over(all_before)).otherwise(F.lit(0))
