"""Incremental synchronisation as streams: quiet periods of a change feed, and snapshots kept by key."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from graphloom.operators.store import VersionedTable


def quiet_periods(changes: DataFrame, gap: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of runs of changes (ts, key) that no gap interrupts: what a debounce timer would hand on at once."""
    if changes.isStreaming:
        changes = changes.withWatermark("ts", late)
    return changes.groupBy(F.session_window("ts", gap), "key").agg(F.count(F.lit(1)).alias("n")).select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def apply_changes(table: VersionedTable, batch: DataFrame, key: str, order: str, deleted: str) -> int:
    """One batch of changes over the current version: the last change of each key by `order` counts, also against what came in earlier batches.

    The table keeps `order`, and the keys that are deleted with their mark, so
    that an older change that comes later finds a newer one; live() leaves them out.
    """
    rows = batch.unionByName(table.read()) if table.version() else batch
    last = rows.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("row")).select("row.*")
    return table.swap(last)


def live(table: VersionedTable, deleted: str) -> DataFrame:
    """The rows of a table that are not deleted, without the mark."""
    return table.read().filter(~F.col(deleted)).drop(deleted)


def sync_stream(source: DataFrame, table: VersionedTable, key: str, order: str, deleted: str, checkpoint: str) -> StreamingQuery:
    """Upserts a stream of changes into a versioned table; a batch that runs again gives the same table."""
    def step(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            apply_changes(table, batch, key, order, deleted)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_retries(start: Callable[[], StreamingQuery], tries: int = 5, first_wait: float = 2.0, most: float = 30.0) -> bool:
    """Runs a stream to its end, again after it failed with doubled waits; False after the last try, with the failure in the log. Errors of starting it are raised."""
    for k in range(tries):
        query = start()
        try:
            query.awaitTermination()
            return True
        except StreamingQueryException as error:
            logging.getLogger(__name__).warning("try %d of %d failed: %s", k + 1, tries, error)
            if k < tries - 1:
                time.sleep(min(most, first_wait * 2**k))
    return False


class Progress(StreamingQueryListener):
    """Hands each event of the session's streams to `tell` as (event, query name or id, batch, rows): started, progress, idle or ended."""

    def __init__(self, tell: Callable[[str, str, int, int], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell("started", str(event.name or event.id), -1, 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell("progress", str(p.name or p.id), p.batchId, int(p.numInputRows))

    def onQueryIdle(self, event) -> None:
        self.tell("idle", str(event.id), -1, 0)

    def onQueryTerminated(self, event) -> None:
        self.tell("ended" if event.exception is None else "failed", str(event.id), -1, 0)


def file_stream(spark: SparkSession, path: str, schema, pattern: str = "*", per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(path)
