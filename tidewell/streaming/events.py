"""Windowed totals and sessions over a stream of events.

Streams run until nothing new is there and go on from their checkpoint at the next call, so a run that is stopped and started again loses and doubles nothing.

Windows: each micro-batch writes the windows that it changed, in a folder named by the batch's number, which a repeated batch overwrites; a
window's latest row counts (``latest``). An event that comes when its window has ended before the watermark (the latest event time seen in earlier
batches less the delay) is late and is left out.

Sessions: a user's events no more than a gap apart. Open sessions are state; a session is told once, when the watermark has passed its end
by the gap. An event before the watermark is late and is left out. So a user's state holds at most as many sessions as fit, a gap apart, between
the watermark and the latest event. Sessions still open at the end of a run stay in the state for the next.

Events without a time, or for sessions a user, are left out; a null value counts as 0 in totals.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.sources.work import ship_package

#: Digits of a window's total.
MONEY = "decimal(18,2)"


def event_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """The Parquet files of a folder (or a single one), each once, as they come, at most ``files_at_once`` in a micro-batch; times as timestamps."""
    path = path.rstrip("/")
    schema = spark.read.parquet(path).schema
    # Spark streams a single file only if a pattern names it; this one matches nothing else.
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str, slide: str | None = None, delay: str | None = None, by: str = "event_type") -> DataFrame:
    """(start, by, n, total) of each window of ``length``, every ``slide``, of a table or of a stream with a watermark of ``delay``."""
    rows = events.where(F.col("ts").isNotNull())
    if delay:
        rows = rows.withWatermark("ts", delay)
    of: Column = F.window("ts", length, slide) if slide else F.window("ts", length)
    sums = rows.groupBy(of.alias("w"), by).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("value").cast(MONEY), F.lit(0))).alias("total"))
    return sums.select(F.col("w.start").alias("start"), by, "n", F.col("total").cast("decimal(28,2)").alias("total"))


def run_windows(sums: DataFrame, folder: str) -> None:
    """Bring the table in ``folder`` up to date with a stream that ``windowed`` has made."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")

    query = sums.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The table that ``run_windows`` keeps: of each key the row of the last batch that changed it."""
    told = spark.read.parquet(f"{folder}/changes")
    rest = [c for c in told.columns if c not in (*keys, "batch")]
    return told.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


class OpenSessions:
    """Sessions of one user as sorted lists: starts, ends, events, totals in hundredths."""

    def __init__(self, lists: tuple | None, gap: int):
        self.start, self.end, self.n, self.total = map(list, lists or ([], [], [], []))
        self.gap = gap

    def add(self, at: int, value: int) -> None:
        """An event joins the sessions that it is no more than a gap away from; two that it lies between become one."""
        i = bisect_left(self.end, at - self.gap)  # the first that doesn't end too early
        j = i
        while j < len(self.start) and self.start[j] <= at + self.gap:
            j += 1
        start, end = min([at, *self.start[i:j]]), max([at, *self.end[i:j]])
        for kept, new in ((self.start, start), (self.end, end), (self.n, 1 + sum(self.n[i:j])), (self.total, value + sum(self.total[i:j]))):
            kept[i:j] = [new]

    def closed(self, watermark: int) -> list[tuple[int, int, int, int]]:
        """Takes out the sessions that no later event can join."""
        k = bisect_left(self.end, watermark - self.gap)  # ends before that
        out = list(zip(self.start[:k], self.end[:k], self.n[:k], self.total[:k], strict=True))
        for kept in (self.start, self.end, self.n, self.total):
            del kept[:k]
        return out


def _sessions(gap: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs() * 1000
        held = OpenSessions(state.get if state.exists else None, gap)
        if not state.hasTimedOut:
            for f in frames:
                for at, value in zip(f["us"].tolist(), f["cents"].tolist(), strict=True):
                    if at >= watermark:
                        held.add(at, value)
        told = held.closed(watermark)
        if held.start:
            state.update((held.start, held.end, held.n, held.total))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (held.end[0] + gap) // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*key, *s) for s in told], columns=["user_id", "first", "last", "n", "cents"])

    return run


def session_stream(events: DataFrame, gap_seconds: int, delay: str) -> DataFrame:
    """(user_id, first, last, n, total) of each session of a stream, told when it is closed."""
    ship_package(events.sparkSession)
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    bare = rows.select("user_id", "ts", F.unix_micros("ts").alias("us"), (F.coalesce(F.col("value").cast(MONEY), F.lit(0)) * 100).cast("long").alias("cents"))
    kind = events.schema["user_id"].dataType.simpleString()
    told = bare.groupBy("user_id").applyInPandasWithState(_sessions(gap_seconds * 1_000_000), f"user_id {kind}, first long, last long, n long, cents long", "start array<long>, `end` array<long>, n array<long>, total array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select("user_id", F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n", (F.col("cents").cast("decimal(24,0)") / 100).cast("decimal(28,2)").alias("total"))


def run_sessions(sessions: DataFrame, folder: str) -> None:
    """Add the sessions that are closed by now to the table in ``folder``, each once."""
    sessions.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/sessions").trigger(availableNow=True).start().awaitTermination()


def sessions_of(events: DataFrame, gap_seconds: int) -> DataFrame:
    """The same of a table, all sessions closed: each event that comes more than a gap after the one before it begins a session."""
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    told = rows.groupBy("user_id", F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.sum(F.coalesce(F.col("value").cast(MONEY), F.lit(0))).cast("decimal(28,2)").alias("total"))
    return told.drop("w")
