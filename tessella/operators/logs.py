"""Log lines to events, events to intervals, intervals to cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import half_up


def parse_lines(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, ts, state of lines like `2024-01-01T10:00:00Z ... desired=1`; other lines go."""
    pattern = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?)\b.*?\bdesired[=: ]+([01])\b"
    out = lines.select(*keep, F.regexp_extract(column, pattern, 1).alias("t"), F.regexp_extract(column, pattern, 2).alias("s")).where("t <> ''")
    return out.select(*keep, F.to_timestamp(F.regexp_replace("t", "Z$", "")).alias("ts"), F.col("s").cast("int").alias("state"))


def intervals(events: DataFrame, keys: list[str], time: str, tie: str, up: Column, down: Column) -> DataFrame:
    """keys, start, end: each up that a down follows; of two ups the later counts, an up without a down doesn't."""
    state = F.when(up, 1).when(down, 0)
    by = Window.partitionBy(*keys).orderBy(time, tie)
    nxt = events.select(*keys, F.col(time).alias("start"), state.alias("_s"), F.lead(state).over(by).alias("_next"), F.lead(time).over(by).alias("end"))
    return nxt.where((F.col("_s") == 1) & (F.col("_next") == 0)).select(*keys, "start", "end")


def blended_cost(spans: DataFrame, jobs: DataFrame, rate_per_hour: float) -> DataFrame:
    """n, cost: cost of all hours by job, null without jobs; jobs: one row with n."""
    hours = spans.agg((F.sum(F.col("end") - F.col("start")) / 3_600_000.0).alias("h"))
    return jobs.crossJoin(hours).select("n", half_up(F.col("h") * rate_per_hour / F.nullif("n", F.lit(0)), 6).alias("cost"))
