"""A feed that is read page by page behind a cursor, as a streaming source of Spark.

`spark.readStream.format("cursor_feed").option("pages", folder)`: the folder, which all executors share,
holds a JSON file for each page, named by its number with leading zeros, with the lists added, modified
and removed. The cursor is the number of pages taken, and Spark's checkpoint remembers it. Pages are
listed on the driver and read by the executors, each with retries.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ledgerloom.sources.retry import FeedError, retried

SCHEMA = "op string, seq bigint, id string, account_id string, date string, amount double, name string"


class _Page(InputPartition):
    def __init__(self, path: str, number: int):
        super().__init__(path)
        self.path, self.number = path, number


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self._folder = folder

    def _pages(self) -> list[str]:
        return sorted(f for f in os.listdir(self._folder) if f.endswith(".json"))

    def initialOffset(self) -> dict:
        return {"cursor": 0}

    def latestOffset(self) -> dict:
        return {"cursor": len(self._pages())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        pages = self._pages()
        return [_Page(os.path.join(self._folder, pages[i]), i) for i in range(start["cursor"], end["cursor"])]

    def commit(self, end: dict) -> None:
        """Pages stay where they are; the checkpoint holds the cursor."""

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        def load() -> dict:
            try:
                with open(partition.path, encoding="utf-8") as f:
                    return json.load(f)
            except OSError as e:
                raise FeedError(str(e), status=503) from e

        page = retried(load)
        rows = [(op, r) for op in ("added", "modified", "removed") for r in page.get(op) or []]
        for i, (op, r) in enumerate(rows):
            yield op, partition.number * 1_000_000 + i, r.get("transaction_id"), r.get("account_id"), r.get("date"), None if r.get("amount") is None else float(r["amount"]), r.get("name")


class CursorFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cursor_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options["pages"])
