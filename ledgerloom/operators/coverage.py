"""Which days of a requested window the known ranges of each account leave open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.intervals import periods_and_gaps


def uncovered(ranges: DataFrame, entity: str, start: str, end: str, window_start: Column, window_end: Column) -> DataFrame:
    """(entity, gap_start, gap_end): the window minus each entity's merged ranges.

    Where a range begins exactly on the window's last day, the gap before it runs to that day and so
    overlaps it by one. Ranges that begin after the window end a gap at the window's end.
    """
    merged = periods_and_gaps(ranges, entity, start, end).where("kind = 'period'").select(F.col(entity).alias("e"), F.col("start_day").alias("s"), F.col("end_day").alias("t"))
    w = Window.partitionBy("e").orderBy("s")
    merged = merged.select("e", "s", "t", window_start.alias("a"), window_end.alias("b"))
    before = F.greatest(F.col("a"), F.coalesce(F.date_add(F.lag("t").over(w), 1), F.col("a")))
    rows = merged.withColumn("cursor", before).withColumn("last", F.lead("s").over(w).isNull())
    gap_end = F.when(F.col("s") < F.col("b"), F.date_sub("s", 1)).otherwise(F.col("b"))
    inner = F.when((F.col("s") > F.col("cursor")) & (F.col("cursor") <= F.col("b")) & (F.col("cursor") <= gap_end), F.struct(F.col("cursor").alias("x"), gap_end.alias("y")))
    after = F.greatest(F.col("cursor"), F.date_add("t", 1))
    tail = F.when(F.col("last") & (after <= F.col("b")), F.struct(after.alias("x"), F.col("b").alias("y")))
    out = rows.select("e", F.explode(F.array_compact(F.array(inner, tail))).alias("g"))
    return out.select(F.col("e").alias(entity), F.col("g.x").alias("gap_start"), F.col("g.y").alias("gap_end"))


def rows_in_gaps(rows: DataFrame, entity: str, day: str, gaps: DataFrame) -> DataFrame:
    """Rows whose day falls into a gap of their entity.

    Gaps are spread over the months they touch and met by month, so that neither side is compared with
    the whole other side.
    """
    months = F.sequence(F.trunc("gap_start", "month"), F.trunc("gap_end", "month"), F.expr("interval 1 month"))
    spread = gaps.select(F.col(entity).alias("__e"), "gap_start", "gap_end", F.explode(months).alias("__m"))
    return rows.join(spread, (rows[entity] == spread["__e"]) & (F.trunc(rows[day], "month") == spread["__m"]) & rows[day].between(spread["gap_start"], spread["gap_end"]), "left_semi")
