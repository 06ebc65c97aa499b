"""Workflow times and event-by-event behaviour, over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.numbers import half_up
from tessella.operators import workflow as wf
from tessella.plans.registry import js, query
from tessella.sources.tables import view
from tessella.streaming import batch as st

_DWELL = "t AS (SELECT *, lead(ts_ms) OVER (PARTITION BY workflow_id ORDER BY ts_ms, event_id) - ts_ms AS dwell_ms FROM workflow_events)"
AS_OF = 1706745600000  # 2024-02-01


@query("wn2_workflow_kpi", f"WITH {_DWELL} SELECT state, count(*) AS n, {js('avg(dwell_ms)')} AS avg_ms, quantile_disc(dwell_ms, 0.5) AS p50_ms, quantile_disc(dwell_ms, 0.9) AS p90_ms, {js('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)', 4)} AS share FROM t WHERE dwell_ms IS NOT NULL GROUP BY state", "workflow_events")
def _(spark, d):
    return wf.state_report(view(spark, d, "workflow_events"))


@query("wn3_state_totals", f"WITH {_DWELL} SELECT workflow_id, state, CAST(sum(dwell_ms) AS BIGINT) AS total_ms FROM t WHERE dwell_ms > 0 GROUP BY 1, 2", "workflow_events")
def _(spark, d):
    return wf.state_totals(view(spark, d, "workflow_events"))


_FINAL = f"""{_DWELL}, f AS (SELECT workflow_id, max(ts_ms) - min(ts_ms) AS elapsed_ms, CAST(coalesce(sum(dwell_ms) FILTER (state IN ('view', 'click')), 0) AS BIGINT) AS machine_ms, CAST(coalesce(sum(dwell_ms) FILTER (state = 'signup'), 0) AS BIGINT) AS wait_ms, CAST(coalesce(sum(dwell_ms) FILTER (state = 'purchase'), 0) AS BIGINT) AS active_ms FROM t GROUP BY 1)"""


def _finals(spark, d):
    return wf.finalise(view(spark, d, "workflow_events"), ["view", "click"], ["signup"], ["purchase"])


@query("ag39_workflow_final", f"WITH {_FINAL} SELECT *, greatest(0, elapsed_ms - machine_ms - wait_ms - active_ms) AS idle_ms FROM f", "workflow_events")
def _(spark, d):
    return _finals(spark, d)


@query("ag38_batch_final", f"WITH {_FINAL} SELECT workflow_id % 7 AS batch_id, count(*) AS n_workflows, CAST(coalesce(sum(nullif(elapsed_ms, 0)), 0) AS BIGINT) AS total_ms, {js('avg(nullif(elapsed_ms, 0))')} AS avg_ms, count(*) FILTER (wait_ms = 0) * 60000 AS saved_ms FROM f GROUP BY 1", "workflow_events")
def _(spark, d):
    return wf.batches(_finals(spark, d), F.col("workflow_id") % 7, 60000)


@query("ag37_kpi_report", f"WITH {_FINAL} SELECT count(*) AS n, {js('avg(elapsed_ms)')} AS avg_ms, quantile_disc(elapsed_ms, 0.5) AS p50_ms, quantile_disc(elapsed_ms, 0.9) AS p90_ms, {js('count(*) FILTER (wait_ms = 0) / CAST(count(*) AS DOUBLE)', 4)} AS auto_rate FROM f", "workflow_events")
def _(spark, d):
    from tessella.functions.numbers import nearest_rank

    f = _finals(spark, d)
    return f.agg(F.count("*").alias("n"), half_up(F.avg("elapsed_ms")).alias("avg_ms"), nearest_rank("elapsed_ms", 0.5).alias("p50_ms"), nearest_rank("elapsed_ms", 0.9).alias("p90_ms"), half_up(F.count_if(F.col("wait_ms") == 0) / F.count("*"), 4).alias("auto_rate"))


@query("wn21_gate_wait", "WITH n AS (SELECT *, lead(state) OVER w AS ns, lead(ts_ms) OVER w AS nt FROM workflow_events WINDOW w AS (PARTITION BY workflow_id ORDER BY ts_ms, event_id)) SELECT workflow_id, event_id, greatest(0, nt - ts_ms) AS wait_ms FROM n WHERE state = 'signup' AND ns = 'view'", "workflow_events")
def _(spark, d):
    return wf.gate_wait(view(spark, d, "workflow_events"), "signup", "view")


@query("ss9_illegal_transitions", "WITH n AS (SELECT workflow_id, event_id, lag(state) OVER (PARTITION BY workflow_id ORDER BY ts_ms, event_id) AS from_state, state AS to_state FROM workflow_events) SELECT * FROM n WHERE from_state IS NOT NULL AND (from_state, to_state) NOT IN (('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('view', 'view'))", "workflow_events")
def _(spark, d):
    legal = spark.createDataFrame([("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view")], "from_state string, to_state string")
    return wf.illegal_transitions(view(spark, d, "workflow_events"), legal)


@query("ss7_stuck", f"WITH l AS (SELECT workflow_id, arg_max(state, (ts_ms, event_id)) AS state, max(ts_ms) AS ts_ms FROM workflow_events GROUP BY 1) SELECT * FROM l WHERE state IN ('view', 'signup') AND ts_ms < {AS_OF} - 300000", "workflow_events")
def _(spark, d):
    return wf.stuck(view(spark, d, "workflow_events"), AS_OF, ["view", "signup"])


@query("ss6_gate_timeouts", f"WITH l AS (SELECT workflow_id, arg_max(state, (ts_ms, event_id)) AS state, max(ts_ms) AS ts_ms FROM workflow_events GROUP BY 1) SELECT * FROM l WHERE {AS_OF} - ts_ms > CASE state WHEN 'signup' THEN 24 WHEN 'view' THEN 48 WHEN 'purchase' THEN 48 WHEN 'error' THEN 72 END * 3600000", "workflow_events")
def _(spark, d):
    return wf.timed_out(view(spark, d, "workflow_events"), AS_OF)


@query("ss1_tumbling_counts", "SELECT workflow_id, (ts_ms // 3600000) * 3600000 AS window_ms, count(*) AS n FROM workflow_events GROUP BY 1, 2", "workflow_events")
def _(spark, d):
    return st.tumbling_counts(view(spark, d, "workflow_events"), 3_600_000)


@query("ss2_hourly_and_daily", f"SELECT workflow_id, (ts_ms // 86400000) * 86400000 AS day_ms, count(*) AS calls, {js('sum(value)', 2)} AS tokens FROM workflow_events GROUP BY 1, 2", "workflow_events")
def _(spark, d):
    e = view(spark, d, "workflow_events")
    day = F.floor(F.col("ts_ms") / 86_400_000) * 86_400_000
    return e.groupBy("workflow_id", day.alias("day_ms")).agg(F.count("*").alias("calls"), half_up(F.sum("value"), 2).alias("tokens"))


@query("ss3_anchored_windows")
def _(spark, d):
    return st.anchored_windows(view(spark, d, "workflow_events"), 6 * 3_600_000, 3)


@query("ss4_token_bucket")
def _(spark, d):
    return st.token_bucket(view(spark, d, "workflow_events"), 3.0, 1.0 / 3_600_000)


@query("ss8_running_counts", "SELECT workflow_id % 7 AS batch_id, state, count(*) AS n FROM workflow_events GROUP BY 1, 2", "workflow_events")
def _(spark, d):
    return view(spark, d, "workflow_events").groupBy((F.col("workflow_id") % 7).alias("batch_id"), "state").agg(F.count("*").alias("n"))


@query("ss10_job_attempts")
def _(spark, d):
    """Users as jobs: a purchase is an attempt that went well, anything else one that failed."""
    e = view(spark, d, "workflow_events")
    return st.job_attempts(e.select(F.col("workflow_id").alias("job_id"), "event_id", "ts_ms", (F.col("state") == "purchase").alias("ok")))


@query("ss11_idempotent", "SELECT workflow_id, state, min(event_id) AS event_id FROM workflow_events GROUP BY 1, 2", "workflow_events")
def _(spark, d):
    e = view(spark, d, "workflow_events")
    return e.unionByName(e).groupBy("workflow_id", "state").agg(F.min("event_id").alias("event_id"))
