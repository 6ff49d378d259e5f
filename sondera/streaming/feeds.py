"""Feeds and logs as Structured Streaming queries. Each has a batch twin that it must agree with once all has come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The store that state with timers and an end needs: a setting of the session, before the stream begins.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def works_feed(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """New works of a feed that is read again with overlap: each id once, state kept for the overlap only."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def append_new(batch: DataFrame, path: str) -> None:
    """For foreachBatch: append the rows of a micro-batch whose id the table at ``path`` hasn't got."""
    spark = batch.sparkSession
    one = batch.dropDuplicates(["id"])
    try:
        one = one.join(spark.read.parquet(path).select("id"), "id", "left_anti")
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    one.write.mode("append").parquet(path)


def lowest_version(stream: DataFrame) -> DataFrame:
    """(base, version, ts): the first row seen of each base, ignoring its later versions."""
    return stream.withColumn("base", F.regexp_replace("url", r"v\d+$", "")).dropDuplicates(["base"])


def counts_by_window(stream: DataFrame, width: str, late: str, slide: str | None = None, *by: str) -> DataFrame:
    """Counts per tumbling or sliding window, late rows allowed for."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def run_sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each run: events with less than ``gap`` between them."""
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "job_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("job_id", F.col("s.start").alias("start"), "n")


def stuck_runs(stream: DataFrame, idle_seconds: int) -> DataFrame:
    """(job_id, last_seq, alarms): runs without progress for ``idle_seconds`` of event time, by state with a timer."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ts = state.get if state.exists else (-1, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "last_seq": [last]})
            return
        for b in batches:
            last, ts = max(last, int(b["seq"].max())), max(ts, int(b["ts"].max().timestamp() * 1000))
        state.update((last, ts))
        state.setTimeoutTimestamp(ts + idle_seconds * 1000)

    return stream.withWatermark("ts", "0 seconds").groupBy("job_id").applyInPandasWithState(watch, "job_id long, last_seq long", "last long, ts long", "append", GroupStateTimeout.EventTimeTimeout)


class _Idle(StatefulProcessor):
    """Keeps the last step of a run and a timer that each new step puts off."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = max((int(b["seq"].max()) for b in rows if len(b)), default=-1)
        before = self.last.get() if self.last.exists() else (-1, None)
        if seen > before[0]:
            if before[1] is not None:
                self.handle.deleteTimer(before[1])
            due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(due)
            self.last.update((seen, due))
        yield pd.DataFrame({"job_id": [], "last_seq": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"job_id": [key[0]], "last_seq": [last]})

    def close(self) -> None:
        pass


def idle_alarms(stream: DataFrame, idle_seconds: float) -> DataFrame:
    """(job_id, last_seq): runs of ``stream`` (job_id, seq) that have made no progress for so long on the clock.

    The alarm needs no later event of any run. A step that is no further than the last is no progress. A run's state
    goes with its alarm. The session must have STATE_STORE set.
    """
    own = stream.select("job_id", "seq").groupBy("job_id")
    return own.transformWithStateInPandas(_Idle(int(idle_seconds * 1000)), "job_id long, last_seq long", "append", "processingTime")


class _Lowest(StatefulProcessor):
    """Keeps the lowest version of a base for a time."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "version int", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        low = min(int(b["version"].min()) for b in rows if len(b))
        held = self.version.get()[0] if self.version.exists() else None
        if held is None or low < held:
            self.version.update((low,))
            yield pd.DataFrame({"base": [key[0]], "version": [low]})
        else:
            yield pd.DataFrame({"base": pd.Series([], dtype="object"), "version": pd.Series([], dtype="int32")})

    def close(self) -> None:
        pass


def replaced_versions(stream: DataFrame, keep_seconds: float) -> DataFrame:
    """(base, version): the lowest version of each base of ``stream`` (url) so far; a lower one that comes later replaces it.

    Rows are updates by base. What has had no update for ``keep_seconds`` is forgotten, so state has an end. The session
    must have STATE_STORE set.
    """
    version = F.coalesce(F.nullif(F.regexp_extract("url", r"v(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))
    own = stream.select(F.regexp_replace("url", r"v\d+$", "").alias("base"), version.alias("version")).groupBy("base")
    return own.transformWithStateInPandas(_Lowest(int(keep_seconds * 1000)), "base string, version int", "update", "processingTime")


def feed_status(outcomes: DataFrame) -> DataFrame:
    """One code for feeds (feed, failed, partial) that ran apart: 1 if all failed, 23 if some did or came in part, else 0."""
    n, bad = F.count(F.lit(1)), F.count_if("failed")
    return outcomes.agg(F.when(bad == n, 1).when((bad > 0) | (F.count_if("partial") > 0), 23).otherwise(0).alias("status"))
