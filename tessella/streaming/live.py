"""Structured Streaming forms. The reports use processing time; event time and watermarks here are an extension."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .batch import anchor, attempt, refill


def event_stream(spark, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def tumbling_counts(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """workflow_id, window start, n; events later than `late` behind the newest don't count any more."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "workflow_id").agg(F.count("*").alias("n")).select("workflow_id", F.col("w.start").alias("window_start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """One event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counts so far; for output mode update."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def _by_time(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["ts_ms", "event_id"], kind="stable")


def anchored_windows(events: DataFrame, width_ms: int, limit: int) -> DataFrame:
    """As batch.anchored_windows(); state: the open window's start and count."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _by_time(frames)
        start, count = state.get if state.exists else (None, 0)
        starts, places, start, count = anchor(pdf["ts_ms"].to_numpy(), width_ms, start, count)
        state.update((start, count))
        yield pd.DataFrame({"workflow_id": key[0], "event_id": pdf["event_id"].to_numpy(), "window_ms": starts, "place": places, "allowed": [p <= limit for p in places]})

    return events.groupBy("workflow_id").applyInPandasWithState(step, "workflow_id bigint, event_id bigint, window_ms bigint, place bigint, allowed boolean", "start bigint, n bigint", "append", GroupStateTimeout.NoTimeout)


def token_bucket(events: DataFrame, capacity: float, per_ms: float) -> DataFrame:
    """As batch.token_bucket(); state: the level and when it was taken."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _by_time(frames)
        level, last = state.get if state.exists else (None, None)
        allowed, level, last = refill(pdf["ts_ms"].to_numpy(), capacity, per_ms, level, last)
        state.update((level, last))
        yield pd.DataFrame({"workflow_id": key[0], "event_id": pdf["event_id"].to_numpy(), "allowed": allowed})

    return events.groupBy("workflow_id").applyInPandasWithState(step, "workflow_id bigint, event_id bigint, allowed boolean", "level double, last bigint", "append", GroupStateTimeout.NoTimeout)


def state_totals(events: DataFrame) -> DataFrame:
    """workflow_id, state, dwell_ms as each state ends; state: the open one and since when."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _by_time(frames)
        name, since = state.get if state.exists else (None, None)
        rows = []
        for s, t in zip(pdf["state"].tolist(), pdf["ts_ms"].tolist(), strict=True):
            if name is not None and t > since:
                rows.append((key[0], name, t - since))
            name, since = s, t
        state.update((name, since))
        yield pd.DataFrame(rows, columns=["workflow_id", "state", "dwell_ms"])

    return events.groupBy("workflow_id").applyInPandasWithState(step, "workflow_id bigint, state string, dwell_ms bigint", "state string, since bigint", "append", GroupStateTimeout.NoTimeout)


class _Jobs(StatefulProcessor):
    """State of a job: failures so far and when it is forgotten, for which a timer stands; nothing is kept beyond that."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", StructType([StructField("failures", LongType()), StructField("until", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = _by_time(rows)
        state = tuple(self.job.get()) if self.job.exists() else (0, None)
        out, old = [], state[1]
        for event, ts, ok in zip(pdf["event_id"].tolist(), pdf["ts_ms"].tolist(), pdf["ok"].tolist(), strict=True):
            verdict, due, state = attempt(state, ts, bool(ok))
            out.append((key[0], event, verdict, due))
        self.job.update(state)
        if state[1] != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if state[1] is not None:
                self.handle.registerTimer(state[1])
        yield pd.DataFrame(out, columns=["job_id", "event_id", "verdict", "due_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.job.clear()
        yield pd.DataFrame({"job_id": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "verdict": pd.Series(dtype="object"), "due_ms": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def job_attempts(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """As batch.job_attempts(), for a stream with a timestamp ts: each outcome's verdict as it comes in.

    Needs the RocksDB state store. A timer at the end of its retention takes a job's state away once no event can be
    earlier; outputs don't depend on it, as a later outcome starts anew anyway. Delivered once more, outcomes are DUPLICATE.
    """
    out = StructType([StructField("job_id", LongType()), StructField("event_id", LongType()), StructField("verdict", StringType()), StructField("due_ms", LongType())])
    return events.withWatermark("ts", late).groupBy("job_id").transformWithStateInPandas(_Jobs(), out, "Append", "EventTime")


def fan_out(updates: DataFrame, channels: dict, key: str):
    """A stream writer that hands each batch's rows to the channel of their key: channels maps key values to functions of a DataFrame."""

    def each(batch: DataFrame, _: int) -> None:
        for name, send in channels.items():
            send(batch.where(F.col(key) == name))

    return updates.writeStream.foreachBatch(each)
