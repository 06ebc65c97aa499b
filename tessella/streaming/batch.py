"""What the stateful operators give over a whole log: the yardstick of the streaming forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.kernels import Columns, per_group


def tumbling_counts(events: DataFrame, width_ms: int) -> DataFrame:
    """workflow_id, window_ms, n: windows start at whole multiples of the width."""
    start = F.floor(F.col("ts_ms") / width_ms) * width_ms
    return events.groupBy("workflow_id", start.alias("window_ms")).agg(F.count("*").alias("n"))


def anchor(times: np.ndarray, width: int, start: int | None = None, count: int = 0) -> tuple[list[int], list[int], int | None, int]:
    """Window start and place in it for each time: a window opens with the first event after the last one has closed."""
    starts, places = [], []
    for t in times.tolist():
        if start is None or t >= start + width:
            start, count = t, 0
        count += 1
        starts.append(start)
        places.append(count)
    return starts, places, start, count


def anchored_windows(events: DataFrame, width_ms: int, limit: int) -> DataFrame:
    """workflow_id, event_id, window_ms, place, allowed (place up to limit)."""

    def kernel(g: Columns) -> Columns:
        starts, places, _, _ = anchor(g["ts_ms"], width_ms)
        p = np.array(places, np.int64)
        return {"event_id": g["event_id"], "window_ms": np.array(starts, np.int64), "place": p, "allowed": p <= limit}

    return per_group(events, ["workflow_id"], ["ts_ms", "event_id"], ["ts_ms", "event_id"], kernel, {"event_id": "bigint", "window_ms": "bigint", "place": "bigint", "allowed": "boolean"})


def refill(times: np.ndarray, capacity: float, per_ms: float, level: float | None = None, last: int | None = None) -> tuple[list[bool], float, int | None]:
    """Whether each event finds a token; the bucket starts full and refills at a steady rate."""
    level = capacity if level is None else level
    allowed = []
    for t in times.tolist():
        if last is not None:
            level = min(capacity, level + (t - last) * per_ms)
        last = t
        ok = level >= 1.0
        level -= ok
        allowed.append(ok)
    return allowed, level, last


def token_bucket(events: DataFrame, capacity: float, per_ms: float) -> DataFrame:
    """workflow_id, event_id, allowed."""

    def kernel(g: Columns) -> Columns:
        return {"event_id": g["event_id"], "allowed": np.array(refill(g["ts_ms"], capacity, per_ms)[0], bool)}

    return per_group(events, ["workflow_id"], ["ts_ms", "event_id"], ["ts_ms", "event_id"], kernel, {"event_id": "bigint", "allowed": "boolean"})


#: Attempts of a job, the delay before the first repeat, how long finished and failed jobs are remembered.
ATTEMPTS, DELAY_MS, KEEP_DONE_MS, KEEP_FAILED_MS = 3, 1000, 24 * 3_600_000, 7 * 24 * 3_600_000


def attempt(state: tuple[int, int | None], ts_ms: int, ok: bool) -> tuple[str, int | None, tuple[int, int | None]]:
    """What an attempt's outcome means for its job: (verdict, due, new state); state: failures so far, when the job is forgotten.

    A failure is repeated after a delay that doubles each time, the last one fails the job; due: when it is repeated or
    forgotten. Outcomes of a job that has ended, such as a message delivered twice, change nothing until it is forgotten.
    """
    failures, until = state
    if until is not None and ts_ms < until:
        return "DUPLICATE", until, state
    failures = 0 if until is not None else failures
    if ok:
        return "COMPLETED", ts_ms + KEEP_DONE_MS, (failures, ts_ms + KEEP_DONE_MS)
    failures += 1
    if failures >= ATTEMPTS:
        return "FAILED", ts_ms + KEEP_FAILED_MS, (failures, ts_ms + KEEP_FAILED_MS)
    return "RETRY", ts_ms + DELAY_MS * 2 ** (failures - 1), (failures, None)


def job_attempts(events: DataFrame) -> DataFrame:
    """job_id, event_id, verdict, due_ms of every outcome (job_id, event_id, ts_ms, ok), by time and event_id within a job."""

    def job(g: Columns) -> Columns:
        state, out = (0, None), []
        for ts, ok in zip(g["ts_ms"].tolist(), g["ok"].tolist(), strict=True):
            verdict, due, state = attempt(state, ts, ok)
            out.append((verdict, due))
        return {"event_id": g["event_id"], "verdict": np.array([v for v, _ in out], object), "due_ms": np.array([d for _, d in out], np.int64)}

    return per_group(events, ["job_id"], ["ts_ms", "event_id"], ["event_id", "ts_ms", "ok"], job, {"event_id": "bigint", "verdict": "string", "due_ms": "bigint"})
