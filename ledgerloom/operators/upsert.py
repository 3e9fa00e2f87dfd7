"""Importing rows into ledger tables: insert what is absent, replace what is keyed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored. Rows of one key within the batch all stay; null keys are new."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


def inserted(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The table after an insert of what is absent; a changed row whose key is stored is not updated."""
    return existing.unionByName(new_rows(incoming, existing, keys), allowMissingColumns=True)


def replaced(existing: DataFrame, incoming: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The table after a replacement: of all rows of a key the last in `order`, of incoming before stored on a tie."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c != "__new"]
    best = both.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(F.struct(*cols), F.struct(order, "__new")).alias("r"))
    return best.select("r.*")


def surrogate(*parts: str) -> Column:
    """A key from natural keys, the same on every retry."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("\u0000")) for p in parts]), 256)


def tombstoned(ledger: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows whose key was removed keep their place and get flags that say so; reports still count them."""
    gone = removed.select(key).distinct().withColumn("__gone", F.lit(True))
    flags = F.when(F.col("__gone"), F.lit('{"removed": true}')).otherwise(F.col("flags"))
    return ledger.join(gone, key, "left").withColumn("flags", flags).drop("__gone")
