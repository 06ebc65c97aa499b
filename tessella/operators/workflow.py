"""Workflow times from the event log: dwell times, state totals, reports, gates, legal transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import half_up, nearest_rank, rate

#: Hours after which a gate times out.
GATE_HOURS = {"signup": 24, "view": 48, "purchase": 48, "error": 72}


def timeline(events: DataFrame) -> DataFrame:
    """events + next_ms and dwell_ms: a state lasts until its workflow's next event; the last one is open (null)."""
    by = Window.partitionBy("workflow_id").orderBy("ts_ms", "event_id")
    return events.withColumn("next_ms", F.lead("ts_ms").over(by)).withColumn("dwell_ms", F.col("next_ms") - F.col("ts_ms"))


def state_report(events: DataFrame) -> DataFrame:
    """state, n, avg_ms, p50_ms, p90_ms, share: closed states only, percentiles by nearest rank."""
    closed = timeline(events).where("dwell_ms IS NOT NULL")
    out = closed.groupBy("state").agg(F.count("*").alias("n"), half_up(F.avg("dwell_ms")).alias("avg_ms"), nearest_rank("dwell_ms", 0.5).alias("p50_ms"), nearest_rank("dwell_ms", 0.9).alias("p90_ms"))
    return out.withColumn("share", half_up(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def state_totals(events: DataFrame) -> DataFrame:
    """workflow_id, state, total_ms of positive dwell times."""
    return timeline(events).where("dwell_ms > 0").groupBy("workflow_id", "state").agg(F.sum("dwell_ms").alias("total_ms"))


def finalise(events: DataFrame, machine: list[str], waiting: list[str], active: list[str]) -> DataFrame:
    """workflow_id, elapsed, machine, wait, active and idle time; idle is what the others leave, never under 0."""
    t = timeline(events)

    def spent(states: list[str]):
        return F.coalesce(F.sum(F.when(F.col("state").isin(*states), F.col("dwell_ms"))), F.lit(0))

    out = t.groupBy("workflow_id").agg((F.max("ts_ms") - F.min("ts_ms")).alias("elapsed_ms"), spent(machine).alias("machine_ms"), spent(waiting).alias("wait_ms"), spent(active).alias("active_ms"))
    return out.withColumn("idle_ms", F.greatest(F.lit(0), F.col("elapsed_ms") - F.col("machine_ms") - F.col("wait_ms") - F.col("active_ms")))


def batches(finals: DataFrame, batch, baseline_ms: int) -> DataFrame:
    """Totals of each batch: workflows, elapsed (0 counts as none), average, time saved against a baseline for each."""
    elapsed = F.when(F.col("elapsed_ms") != 0, F.col("elapsed_ms"))
    return finals.groupBy(batch.alias("batch_id")).agg(F.count("*").alias("n_workflows"), F.coalesce(F.sum(elapsed), F.lit(0)).alias("total_ms"), half_up(F.avg(elapsed)).alias("avg_ms"), (F.count_if(F.col("wait_ms") == 0) * baseline_ms).alias("saved_ms"))


def illegal_transitions(events: DataFrame, legal: DataFrame) -> DataFrame:
    """workflow_id, event_id, from_state, to_state of moves that `legal`(from_state, to_state) lacks."""
    by = Window.partitionBy("workflow_id").orderBy("ts_ms", "event_id")
    moves = events.select("workflow_id", "event_id", F.lag("state").over(by).alias("from_state"), F.col("state").alias("to_state")).where("from_state IS NOT NULL")
    return moves.join(F.broadcast(legal), ["from_state", "to_state"], "left_anti")


def gate_wait(events: DataFrame, gate: str, review: str) -> DataFrame:
    """Time from entering a gate to the review that follows it, never under 0; gates without a review don't appear."""
    by = Window.partitionBy("workflow_id").orderBy("ts_ms", "event_id")
    nxt = events.select("*", F.lead("state").over(by).alias("next_state"), F.lead("ts_ms").over(by).alias("next_ms"))
    return nxt.where((F.col("state") == gate) & (F.col("next_state") == review)).select("workflow_id", "event_id", F.greatest(F.lit(0), F.col("next_ms") - F.col("ts_ms")).alias("wait_ms"))


def stuck(events: DataFrame, as_of_ms: int, states: list[str], minutes: int = 5) -> DataFrame:
    """Workflows whose last state is recoverable and older than `minutes` at as_of_ms."""
    last = events.groupBy("workflow_id").agg(F.max(F.struct("ts_ms", "event_id", "state")).alias("l")).select("workflow_id", "l.state", "l.ts_ms")
    return last.where(F.col("state").isin(*states) & (F.col("ts_ms") < as_of_ms - minutes * 60_000))


def timed_out(events: DataFrame, as_of_ms: int) -> DataFrame:
    """Workflows whose last state is a gate that has run out at as_of_ms."""
    from itertools import chain

    limit = F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*GATE_HOURS.items())]), F.col("state"))
    last = events.groupBy("workflow_id").agg(F.max(F.struct("ts_ms", "event_id", "state")).alias("l")).select("workflow_id", "l.state", "l.ts_ms")
    return last.where(F.lit(as_of_ms) - F.col("ts_ms") > limit * 3_600_000)


def phase_gate(maps: DataFrame, domain: DataFrame, window: int = 14, target: float = 0.75) -> DataFrame:
    """For each class of the domain: best score of its last `window` runs, missing ones as 0, and PASS from target on, PARTIAL above 0."""
    recent = maps.withColumn("r", F.row_number().over(Window.partitionBy("zone_type").orderBy(F.desc("run_id")))).where(F.col("r") <= window)
    best = recent.groupBy("zone_type").agg(F.max("ap").alias("best"))
    out = domain.join(best, "zone_type", "left").fillna(0.0, ["best"])
    return out.withColumn("status", F.when(F.col("best") >= target, "PASS").when(F.col("best") > 0, "PARTIAL").otherwise("FAIL"))


def throughput(sessions: DataFrame) -> DataFrame:
    """Mean milliseconds per region of blind and assisted sessions and their ratio; sessions without regions don't count."""
    per = F.when(F.col("reviewed") > 0, F.col("active_ms") / F.col("reviewed"))
    out = sessions.agg(F.avg(F.when(F.col("mode") == "blind", per)).alias("blind_ms"), F.avg(F.when(F.col("mode") != "blind", per)).alias("assisted_ms"))
    return out.withColumn("speedup", rate(F.col("blind_ms"), F.col("assisted_ms"), empty=None))
