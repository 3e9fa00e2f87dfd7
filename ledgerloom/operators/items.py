"""The items of a feed as a table: item_id, user_id, institution, status, cursor, synced_at.

Items are few and change seldom, so every change is a new table from the old one; concurrent writers
need a table format that serializes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "item_id string, user_id string, institution string, status string, cursor string, synced_at timestamp"


def put(items: DataFrame, new: DataFrame) -> DataFrame:
    """Items with new ones in the place of those with the same id."""
    return items.join(new.select("item_id"), "item_id", "left_anti").select(items.columns).unionByName(new.select(items.columns))


def without(items: DataFrame, gone: DataFrame) -> DataFrame:
    return items.join(gone.select("item_id"), "item_id", "left_anti").select(items.columns)


def of_user(items: DataFrame, user: str) -> DataFrame:
    return items.where(F.col("user_id") == user)


def with_status(items: DataFrame, states: DataFrame) -> DataFrame:
    """Items in the state that `states` (item_id, status) names; the others as they were."""
    new = states.select("item_id", F.col("status").alias("new_status"))
    return items.join(new, "item_id", "left").withColumn("status", F.coalesce("new_status", "status")).select(items.columns)


def with_cursor(items: DataFrame, cursors: DataFrame, at: Column) -> DataFrame:
    """Items with the cursors they have come to and the time of it; a null cursor begins anew."""
    new = cursors.select("item_id", F.col("cursor").alias("new_cursor"), F.lit(True).alias("moved"))
    x = items.join(new, "item_id", "left")
    return x.withColumn("synced_at", F.when(F.col("moved"), at).otherwise(F.col("synced_at"))).withColumn("cursor", F.when(F.col("moved"), F.col("new_cursor")).otherwise(F.col("cursor"))).select(items.columns)
