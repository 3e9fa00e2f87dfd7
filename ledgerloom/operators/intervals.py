"""Continuous periods and gaps of closed day intervals per entity.

Starts and ends are sorted independently. Let S(k) be the k-th start and E(k) the k-th end of an
entity: nothing covers the days between E(k) and S(k+1) exactly when S(k+1) > E(k) + 1. Equal days
are counted before anything is ranked, so a window holds at most two rows for each calendar day of an
entity, however many intervals the entity has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def boundaries(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, k, end_day, start_day): coverage stops after end_day and goes on at start_day.

    The first row of an entity has no end_day, its last no start_day. Intervals with a null in one of
    the three columns, or that end before they start, cover nothing and are left out.
    """
    ok = df.select(F.col(entity).alias("e"), F.col(start).cast("date").alias("s"), F.col(end).cast("date").alias("t"))
    ok = ok.where(F.col("e").isNotNull() & (F.col("s") <= F.col("t")))
    marks = F.array(
        F.struct(F.lit(0).alias("side"), F.col("s").alias("day")),
        F.struct(F.lit(1).alias("side"), F.col("t").alias("day")),
    )
    days = ok.select("e", F.explode(marks).alias("m")).groupBy("e", "m.side", "m.day").agg(F.count("*").alias("n"))
    # What is left of an entity is no longer than the calendar; placed by entity once, all that follows stays in place.
    days = days.repartition("e")
    w = Window.partitionBy("e", "side").orderBy("day")
    ranked = days.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("total", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # A start meets the end of the rank before its own; only the first of equal starts and the last of
    # equal ends can lie at a gap.
    k = F.when(F.col("side") == 0, F.col("upto") - F.col("n")).otherwise(F.col("upto"))
    met = (
        ranked.withColumn("k", k)
        .groupBy("e", "k")
        .agg(
            F.max(F.when(F.col("side") == 1, F.col("day"))).alias("end_day"),
            F.max(F.when(F.col("side") == 0, F.col("day"))).alias("start_day"),
            F.max("total").alias("total"),
        )
    )
    opens = (F.col("k") == 0) & F.col("start_day").isNotNull()
    closes = F.col("end_day").isNotNull() & (F.col("k") == F.col("total"))
    apart = F.col("start_day") > F.date_add("end_day", 1)
    return met.where(opens | closes | apart).select(F.col("e").alias(entity), "k", "end_day", "start_day")


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, kind, start_day, end_day): each `period` of covered days and each `gap` between two.

    Adjacent intervals (one begins on the day after another ends) make one period. Backward or null
    intervals cover nothing; an entity without a valid interval gives no row; repeated rows change
    nothing; an empty table gives an empty result.
    """
    b = boundaries(df, entity, start, end)
    w = Window.partitionBy(entity).orderBy("k")
    b = b.withColumn("until", F.lead("end_day").over(w))
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("start_day").alias("a"), F.col("until").alias("b")),
        F.struct(F.lit("gap").alias("kind"), F.date_add("end_day", 1).alias("a"), F.date_sub("start_day", 1).alias("b")),
    )
    return (
        b.select(entity, F.explode(rows).alias("r"))
        .where(F.col("r.a").isNotNull() & F.col("r.b").isNotNull())
        .select(entity, "r.kind", F.col("r.a").alias("start_day"), F.col("r.b").alias("end_day"))
    )
