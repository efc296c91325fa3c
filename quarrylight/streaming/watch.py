"""Change streams: events to batches, snapshots to changes, and a stream that keeps a table of files up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quarrylight.functions.text import is_hidden

DEBOUNCE_MS = 250
FLUSH_SECONDS = 5


def wall_micros(ts: str) -> Column:
    """Microseconds since 1970 of a time as its clock shows it, with or without a zone."""
    c = F.col(ts)
    return (F.datediff(c, F.lit("1970-01-01")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60) * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def touched_paths(events: DataFrame) -> DataFrame:
    """(ts, path) of events (ts, kind, src, dest): a move touches two paths; hidden ones are left out."""
    both = events.select("ts", F.explode(F.array_compact(F.when(F.col("kind") == "moved", F.array("src", "dest")).otherwise(F.array("src")))).alias("path"))
    return both.filter(~is_hidden(F.col("path")))


def debounce(events: DataFrame, wait_ms: int = DEBOUNCE_MS, key: str = "stream") -> DataFrame:
    """(key, batch_start, paths): a batch closes a fixed time after its first event; later events do not put that off.

    events: key, ts, path, ordered by ts in each key. Which event opens a batch depends on the one that opened the
    batch before, so each key is folded once, in order.
    """
    us = wait_ms * 1000
    rows = events.select(key, wall_micros("ts").alias("at")).distinct()
    times = rows.groupBy(key).agg(F.array_sort(F.collect_list("at")).alias("at"))
    opened = F.aggregate("at", F.array().cast("array<bigint>"), lambda a, t: F.when((F.size(a) == 0) | (t >= F.element_at(a, -1) + us), F.concat(a, F.array(t))).otherwise(a))
    starts = times.select(key, F.explode(opened).alias("batch_start"))
    w = Window.partitionBy(key).orderBy("_at", "_event").rowsBetween(Window.unboundedPreceding, 0)
    marked = starts.select(key, F.col("batch_start").alias("_at"), F.lit(0).alias("_event"), "batch_start", F.lit(None).cast("string").alias("path")).unionByName(
        events.select(key, wall_micros("ts").alias("_at"), F.lit(1).alias("_event"), F.lit(None).cast("long").alias("batch_start"), "path")
    )
    placed = marked.withColumn("batch_start", F.max("batch_start").over(w)).filter("path IS NOT NULL")
    return placed.groupBy(key, "batch_start").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def snapshot_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) between two snapshots (path, mtime): created, modified or deleted."""
    both = before.select("path", F.col("mtime").alias("_old")).join(now.select("path", F.col("mtime").alias("_new")), "path", "full_outer")
    change = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


class Debouncer(StatefulProcessor):
    """transformWithState form of :func:`debounce` for endless streams: the first event of a key sets a timer, which
    emits all paths that came until then. State is one row a path."""

    def __init__(self, wait_ms: int = DEBOUNCE_MS):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "first long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        for frame in rows:
            for path in frame["path"]:
                if not self.paths.containsKey((path,)):
                    self.paths.updateValue((path,), (now,))
        if not self.due.exists():
            self.due.update((now + self.wait_ms,))
            self.handle.registerTimer(now + self.wait_ms)
        yield pd.DataFrame({"stream": [], "paths": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = sorted(k[0] for k in self.paths.keys())
        self.paths.clear()
        self.due.clear()
        yield pd.DataFrame({"stream": [key[0]], "paths": [found]})

    def close(self) -> None:
        pass


def debounced_stream(events: DataFrame, wait_ms: int = DEBOUNCE_MS) -> DataFrame:
    """(stream, paths) of an endless stream of events (stream, path)."""
    return events.groupBy("stream").transformWithStateInPandas(Debouncer(wait_ms), "stream string, paths array<string>", "append", "processingTime")


def latest_event(events: DataFrame, path: str = "path", order: str = "ts") -> DataFrame:
    """The last event of each path in a batch, all columns."""
    w = Window.partitionBy(path).orderBy(F.col(order).desc(), *[F.col(c).desc_nulls_last() for c in events.columns if c not in (path, order)])
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def start_refresh(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, name: str | None = None, once: bool = False, every: int = FLUSH_SECONDS) -> StreamingQuery:
    """Runs apply(last event of each path, batch id) on every batch of a stream of events.

    A batch whose apply fails is given again when the query starts anew from the same checkpoint, so apply should
    replace what an earlier try of its batch id wrote.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        apply(latest_event(batch), batch_id)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{every} seconds")).start()


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by window and type of a stream or table (ts, event_type), late ones dropped by watermark in a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
