"""Streams over several batches give what the batch forms give over the whole log."""

import pytest
from pyspark.sql import functions as F

from tessella.sources.tables import view
from tessella.streaming import batch, live


@pytest.fixture(scope="module")
def log(spark, sf, tmp_path_factory):
    """The event log in three files, in order of time, and its rows."""
    e = view(spark, sf, "workflow_events").withColumn("ts", F.timestamp_millis("ts_ms"))
    cut = [r[0] for r in e.selectExpr("percentile_approx(ts_ms, array(0.33, 0.66)) AS p").selectExpr("explode(p)").collect()]
    folder = tmp_path_factory.mktemp("log")
    for i, (lo, hi) in enumerate(zip([0, *cut], [*cut, 1 << 60], strict=True)):
        e.where((F.col("ts_ms") >= lo) & (F.col("ts_ms") < hi)).coalesce(1).write.parquet(f"{folder}/{i}")
    return str(folder), e


def _stream(spark, log):
    return spark.readStream.schema(log[1].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(log[0])


def _run(spark, df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    return sorted(map(tuple, spark.table(name).collect()))


def test_token_bucket(spark, log, tmp_path):
    got = _run(spark, live.token_bucket(_stream(spark, log), 1.0, 1 / 400_000_000), "append", tmp_path, "bucket")
    assert got == sorted(map(tuple, batch.token_bucket(log[1], 1.0, 1 / 400_000_000).collect()))
    assert len({g[2] for g in got}) == 2


def test_anchored_windows(spark, log, tmp_path):
    got = _run(spark, live.anchored_windows(_stream(spark, log), 6 * 3_600_000, 3), "append", tmp_path, "windows")
    assert got == sorted(map(tuple, batch.anchored_windows(log[1], 6 * 3_600_000, 3).collect()))


def test_state_totals(spark, log, tmp_path):
    from tessella.operators.workflow import state_totals

    rows = _run(spark, live.state_totals(_stream(spark, log)), "append", tmp_path, "totals")
    sums = {}
    for w, s, ms in rows:
        sums[w, s] = sums.get((w, s), 0) + ms
    assert sums == {(r["workflow_id"], r["state"]): r["total_ms"] for r in state_totals(log[1]).collect()}


def test_running_and_windowed_counts(spark, log, tmp_path):
    got = _run(spark, live.running_counts(_stream(spark, log), ["state"]), "complete", tmp_path, "running")
    assert got == sorted(map(tuple, log[1].groupBy("state").count().collect()))
    first = _run(spark, live.first_seen(_stream(spark, log), ["event_id"]), "append", tmp_path / "f", "first")
    assert len(first) == log[1].count()


def test_fan_out(spark, log, tmp_path):
    seen = {"view": 0, "error": 0}

    def send(name):
        return lambda df: seen.__setitem__(name, seen[name] + df.count())

    q = live.fan_out(_stream(spark, log), {n: send(n) for n in seen}, "state").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert seen == {n: log[1].where(F.col("state") == n).count() for n in seen}


def test_job_attempts_over_a_restart(spark, log, tmp_path):
    """Three attempts, doubling delays and retention as in the batch form, though the query stops and starts again."""
    day = 24 * 3_600_000
    e = log[1].selectExpr("workflow_id % 40 AS job_id", "event_id", "ts_ms", "state = 'purchase' AS ok", "ts")
    want = sorted(map(tuple, batch.job_attempts(e).collect()))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for limit in (1, None):
            stream = _stream(spark, log).selectExpr("workflow_id % 40 AS job_id", "event_id", "ts_ms", "state = 'purchase' AS ok", "ts")
            q = live.job_attempts(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
            if limit:
                q = q.start()
                while not any(p["numInputRows"] for p in q.recentProgress):
                    q.awaitTermination(1)
            else:
                q = q.start()
                q.processAllAvailable()
            q.stop()
        got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("job_id", "event_id", "verdict", "due_ms").collect()))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == want and {g[2] for g in got} == {"RETRY", "FAILED", "COMPLETED", "DUPLICATE"}
    assert batch.KEEP_FAILED_MS == 7 * day


def test_attempts_by_hand():
    day = 24 * 3_600_000
    steps = [(0, False, "RETRY", 1000), (1000, False, "RETRY", 3000), (3000, False, "FAILED", 3000 + 7 * day), (4000, True, "DUPLICATE", 3000 + 7 * day), (3000 + 7 * day, False, "RETRY", 4000 + 7 * day), (4000 + 7 * day, True, "COMPLETED", 4000 + 8 * day)]
    state = (0, None)
    for ts, ok, verdict, due in steps:
        got, at, state = batch.attempt(state, ts, ok)
        assert (got, at) == (verdict, due)
