"""Incremental sync of a feed: changes into a ledger table, and the state of items from their events.

The stream's checkpoint takes the place of a cursor: it moves on after a batch is written, so a batch
may come twice, and the writes are keyed so that this changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.upsert import new_rows, tombstoned

# The state an event puts an item into.
STATES = {"error": "error", "login_required": "login_required", "pending_expiration": "login_required", "login_repaired": "active", "new_accounts": "active", "sync_updates": "active"}
SKIPPED = ("login_required", "error")


def read_changes(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of change files (Parquet) dropped into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)


def apply_changes(changes: DataFrame, ledger: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a batch adds to the ledger and to the list of removed ids.

    changes: op (added, modified, removed), id and the ledger's columns. Added and modified rows are
    inserted only if their id is not stored yet; of several rows of a batch with one id the last by seq.
    """
    cols = ledger.columns
    live = changes.where(F.col("op").isin("added", "modified"))
    last = live.groupBy(F.col("id").alias("__id")).agg(F.max_by(F.struct(*cols), "seq").alias("r")).select("r.*")
    gone = changes.where(F.col("op") == "removed").select("id").distinct()
    return new_rows(last, ledger, ["id"]), new_rows(gone, removed, ["id"])


#: Parts of a bucketed ledger table; the part of a row is a hash of its id.
BUCKETS = 256


def bucketed(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows with the part of the table that their id belongs to, as its partition column."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))


def write_bucketed(rows: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "append") -> None:
    bucketed(rows, buckets).repartition("bucket").write.partitionBy("bucket").mode(mode).parquet(path)


def ledger_view(ledger: DataFrame, removed: DataFrame) -> DataFrame:
    """The ledger as it is read: rows that were removed keep their place and are flagged."""
    return tombstoned(ledger if "flags" in ledger.columns else ledger.withColumn("flags", F.lit("{}")), removed, "id")


def start_sync(changes: DataFrame, ledger_path: str, removed_path: str, checkpoint: str, on_batch: Callable[[int, int], None] | None = None, interval: str | None = None, buckets: int | None = None) -> StreamingQuery:
    """Run the sync; without an interval it takes what is there and ends. Both paths must hold tables already.

    buckets: both tables are partitioned by `bucket` (write_bucketed), and a batch reads only the parts
    that its ids belong to; their numbers, at most so many, are what comes to the driver.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            ledger, removed = spark.read.parquet(ledger_path), spark.read.parquet(removed_path)
            if buckets:
                touched = [r["bucket"] for r in bucketed(batch.select("id"), buckets).select("bucket").distinct().collect()]
                ledger, removed = (x.where(F.col("bucket").isin(touched)).drop("bucket") for x in (ledger, removed))
            add, gone = apply_changes(batch, ledger, removed)
            for rows, path in ((add, ledger_path), (gone, removed_path)):
                if buckets:
                    write_bucketed(rows, path, buckets)
                else:
                    rows.write.mode("append").parquet(path)
            if on_batch:
                on_batch(number, batch.count())
        finally:
            batch.unpersist()

    w = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def item_states(events: DataFrame) -> DataFrame:
    """(item_id, status, since): the state of each item after its last event that has one; ties by the later kind by name."""
    known = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    e = events.withColumn("status", F.try_element_at(known, F.lower("kind"))).where("status is not null")
    return e.groupBy("item_id").agg(F.max_by("status", F.struct("at", "kind")).alias("status"), F.max("at").alias("since"))


def items_to_sync(items: DataFrame, states: DataFrame) -> DataFrame:
    """Items that are not waiting for a login and not failed."""
    return items.join(states, "item_id", "left").where(F.coalesce(~F.col("status").isin(*SKIPPED), F.lit(True)))


def windowed_counts(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Counts and sums of events by window and type, with a watermark for late ones; for streams and tables alike."""
    timed = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", length), "kind").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
