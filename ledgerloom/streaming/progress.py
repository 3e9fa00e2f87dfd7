"""Watching and ending running syncs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls `on_event` with (kind, query name, rows): started, importing with each batch's rows, complete, or error."""

    def __init__(self, on_event: Callable[[str, str, int], None]):
        self._on, self._names = on_event, {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        self._names[str(event.id)] = event.name or str(event.id)
        self._on("started", self._names[str(event.id)], 0)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        self._on("importing", event.progress.name or str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        self._on("error" if event.exception else "complete", self._names.get(str(event.id), str(event.id)), 0)


def watch(spark: SparkSession, on_event: Callable[[str, str, int], None]) -> Progress:
    listener = Progress(on_event)
    spark.streams.addListener(listener)
    return listener


def status(spark: SparkSession) -> list[dict]:
    """Of each running sync: name, whether a batch is under way, batches done, rows of the last one."""
    out = []
    for q in spark.streams.active:
        last = q.lastProgress
        out.append({"name": q.name or str(q.id), "busy": q.status["isTriggerActive"], "batch": last.batchId if last else None, "rows": last.numInputRows if last else 0})
    return out


def stop(query: StreamingQuery, timeout_s: int = 60) -> bool:
    """Let a running batch end, then stop; whether it has stopped."""
    query.stop()
    return query.awaitTermination(timeout_s) if query.isActive else True
