"""Event-time windows over a stream of event files: tumbling, sliding and session windows.

Rows may come out of order. The watermark is the largest time seen so far less
``delay``; a row that is not newer than it is late. Late rows are dropped, and counted:
they are filtered by the first stateful step, which drops repeated deliveries of an
event within the watermark, so the count is of rows and not of partial results.

Windows are written when the watermark has passed their end, once each (append mode,
Parquet sink), with state in RocksDB and a checkpoint in the shared folder: a query that
is started again goes on where it stopped, with no row lost or counted twice.
``flush`` closes the windows that are still open.

State: one entry an event for ``delay``, one for each open window and key. Aggregates are
combined before the shuffle, so a hot key costs a row for each task and window.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: Of the marker row that ``flush`` sends; no result has it.
MARKER = -1
STATE_PARTITIONS = 8


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for a query that is started inside: it keeps a copy, the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_settings(partitions: int) -> dict[str, str]:
    return {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.streaming.numRecentProgressUpdates": "10000",
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@dataclass(frozen=True)
class EventWindows:
    """What is computed: ``width`` alone is a tumbling window, with ``slide`` a sliding one; ``gap`` alone a session.

    ``measures`` are aggregates over the rows of a window and ``keys``, as SQL.
    """
    keys: Sequence[str]
    measures: dict[str, str]
    width: str | None = None
    slide: str | None = None
    gap: str | None = None
    time: str = "ts"
    id: str = "event_id"

    def window(self) -> Column:
        if self.gap:
            return F.session_window(self.time, self.gap)
        return F.window(self.time, self.width, self.slide) if self.slide else F.window(self.time, self.width)

    def batch(self, events: DataFrame) -> DataFrame:
        """The same over a table: what the stream gives if no row is late."""
        once = events.where(F.col(self.time).isNotNull()).dropDuplicates([self.id])
        return self._shaped(once)

    def _shaped(self, events: DataFrame) -> DataFrame:
        out = events.groupBy(self.window().alias("w"), *self.keys).agg(*(F.expr(m).alias(n) for n, m in self.measures.items()))
        return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *self.keys, *self.measures)

    def stream(self, events: DataFrame, delay: str) -> DataFrame:
        timely = events.where(F.col(self.time).isNotNull()).withWatermark(self.time, delay).dropDuplicatesWithinWatermark([self.id])
        return self._shaped(timely)


@dataclass
class WindowStream:
    """Windows over the files that land in ``source``; everything it writes lies in ``folder`` (shared)."""
    spark: SparkSession
    windows: EventWindows
    schema: T.StructType
    source: str
    folder: str
    delay: str
    partitions: int = STATE_PARTITIONS
    late_rows: int = field(default=0, init=False)       # of this object's runs
    batches: int = field(default=0, init=False)

    def start(self, max_files: int | None = None) -> StreamingQuery:
        """A query over what has landed; it stops when all of it is processed."""
        reader = self.spark.readStream.schema(self.schema)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        with settings(self.spark, state_settings(self.partitions)):
            return (self.windows.stream(reader.parquet(f"{self.source}/*"), self.delay).writeStream.format("parquet")
                    .option("path", f"{self.folder}/windows").option("checkpointLocation", f"{self.folder}/checkpoint")
                    .outputMode("append").trigger(availableNow=True).start())

    def run(self, max_files: int | None = None) -> None:
        query = self.start(max_files)
        query.awaitTermination()
        for progress in query.recentProgress:
            self.batches += 1
            self.late_rows += sum(s.numRowsDroppedByWatermark for s in progress.stateOperators if s.operatorName == "dedupeWithinWatermark")

    def flush(self) -> None:
        """Closes all windows: sends a row from far behind the last one. Rows that come later are late."""
        kinds = {f.name: f.dataType for f in self.schema.fields}
        marker = {self.windows.id: F.lit(MARKER), self.windows.time: F.lit("2999-01-01 00:00:00")}
        row = self.spark.range(1).select(*(marker.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()))
        row.write.mode("append").parquet(f"{self.source}/marker")
        self.run()

    def result(self) -> DataFrame:
        """The closed windows."""
        return self.spark.read.parquet(f"{self.folder}/windows")
