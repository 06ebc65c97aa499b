"""Annotation time: totals, per operator, per title, apportioned to types, by day; integer shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import hours, pct, rate

RATE_PER_HOUR = 400.0


def _spent(sessions: DataFrame) -> list[Column]:
    wall = F.coalesce(F.col("ended_ms") - F.col("started_ms"), F.col("active_ms") + F.col("idle_ms"))
    return [hours(F.sum(wall)).alias("wall_clock_hours"), hours(F.sum("active_ms")).alias("active_hours"), hours(F.sum("idle_ms")).alias("idle_hours")]


def totals(sessions: DataFrame, cost: float = RATE_PER_HOUR) -> DataFrame:
    """One row. An open session's wall clock is its active and idle time."""
    return sessions.agg(*_spent(sessions), F.sum("reviewed").alias("zones_reviewed"), rate(F.sum("reviewed"), hours(F.sum("active_ms"))).alias("zones_per_hour"), (hours(F.sum("active_ms")) * cost).alias("cost"))


def per_operator(sessions: DataFrame, cost: float = RATE_PER_HOUR) -> DataFrame:
    decided = F.sum(F.col("confirmed") + F.col("corrected") + F.col("rejected"))
    active = hours(F.sum("active_ms"))
    shares = [pct(F.sum(c), decided).alias(f"{c}_pct") for c in ("confirmed", "corrected", "rejected")]
    return sessions.groupBy("operator_id").agg(active.alias("active_hours"), F.sum("reviewed").alias("zones_reviewed"), rate(F.sum("reviewed"), active).alias("zones_per_hour"), *shares, F.countDistinct("run_id").alias("runs"), (active * cost).alias("cost"))


def per_operator_rates(sessions: DataFrame) -> DataFrame:
    """As per_operator(), rates as fractions and null where nothing was reviewed."""
    reviewed = F.sum("reviewed")
    return sessions.groupBy("operator_id").agg(F.sum("active_ms").alias("active_ms"), reviewed.alias("reviewed"), rate(F.sum("corrected"), reviewed, empty=None).alias("correction_rate"), rate(F.sum("rejected"), reviewed, empty=None).alias("rejection_rate"), F.max("active_ms").alias("longest_ms"))


def per_title(sessions: DataFrame, runs: DataFrame, issues: DataFrame, cost: float = RATE_PER_HOUR) -> DataFrame:
    """run_id, name, hours, cost, issues of every run with a session; costs sum to the total."""
    active = hours(F.sum("active_ms"))
    spent = sessions.groupBy("run_id").agg(active.alias("active_hours"), F.sum("reviewed").alias("zones_reviewed"), (active * cost).alias("cost"))
    counted = issues.groupBy("run_id").agg(F.count("*").alias("n_issues"))
    return spent.join(runs, "run_id", "left").join(counted, "run_id", "left").fillna(0, ["n_issues"])


def seconds_per_type(sessions: DataFrame, zones: DataFrame) -> DataFrame:
    """Each run's active time is shared out over its decided regions' types; types sum over runs.

    Here, unlike elsewhere, only `auto-annotation` counts as no reviewer. Runs without decided regions share out nothing.
    """
    kept = zones.where("decision IS NOT NULL").where(F.coalesce(F.col("verified_by") != "auto-annotation", F.lit(True)))
    counts = kept.groupBy("run_id", F.coalesce(F.nullif(F.col("zone_type"), F.lit("")), F.lit("unknown")).alias("zone_type")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("of_run", F.sum("n").over(Window.partitionBy("run_id")))
    active = sessions.groupBy("run_id").agg(F.sum("active_ms").alias("ms"))
    shared = counts.join(active, "run_id").withColumn("share", F.col("ms") * (F.col("n") / F.col("of_run")))
    return shared.groupBy("zone_type").agg(F.sum("n").alias("total_zones"), (F.sum("share") / F.sum("n") / 1000.0).alias("avg_seconds_per_zone"))


def daily_trend(sessions: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each UTC day from first to last, and for days outside with sessions; a session counts on the day it started."""
    day = F.date_format(F.timestamp_millis("started_ms"), "yyyy-MM-dd")
    spent = sessions.groupBy(day.alias("day")).agg(F.sum("reviewed").alias("reviewed"), hours(F.sum("active_ms")).alias("active_hours"), F.countDistinct("operator_id").alias("operators"))
    days = sessions.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    return days.join(spent, "day", "full_outer").fillna(0)


def distribute(rows: DataFrame, keys: list[str], pool: Column, weight: str, order: list[str]) -> DataFrame:
    """rows + share: whole numbers by weight that sum to the pool of their key; what floors leave goes to the largest remainders, ties in order."""
    by = Window.partitionBy(*keys)
    exact = rows.withColumn("_pool", pool).withColumn("_exact", F.col("_pool") * F.col(weight) / F.nullif(F.sum(weight).over(by), F.lit(0))).withColumn("_floor", F.floor("_exact"))
    exact = exact.withColumn("_left", F.col("_pool") - F.sum("_floor").over(by))
    nth = F.row_number().over(by.orderBy((F.col("_exact") - F.col("_floor")).desc(), *order))
    return exact.withColumn("_nth", nth).withColumn("share", F.coalesce(F.col("_floor") + F.when(F.col("_nth") <= F.col("_left"), 1).otherwise(0), F.lit(0)).cast("long")).drop("_pool", "_exact", "_floor", "_left", "_nth")


def sampled_stretches(pages: DataFrame, keys: list[str], least: int = 3, min_zones: int = 10, max_confirmed: int = 3) -> DataFrame:
    """Stretches of `least` or more adjacent pages with more than min_zones regions and at most max_confirmed confirmed: keys, first, last, n."""
    thin = pages.where((F.col("n_zones") > min_zones) & (F.col("n_confirmed") <= max_confirmed))
    island = F.col("page_number") - F.row_number().over(Window.partitionBy(*keys).orderBy("page_number"))
    return thin.withColumn("island", island).groupBy(*keys, "island").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count("*").alias("n_pages")).where(F.col("n_pages") >= least).drop("island")


def _tenths(x: Column) -> Column:
    """A rate with one decimal, half up; empty where there is none."""
    t = F.floor(x * 10 + 0.5)
    return F.concat((t / 10).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"))


def _shares(total: Column, names: tuple[str, ...] = ("confirmed", "corrected", "rejected")) -> list[Column]:
    return [_tenths(F.when(total > 0, F.col(c) * 100.0 / total)).alias(f"{c[:-2].capitalize()}%") for c in names]


def report_blocks(sessions: DataFrame, decisions: DataFrame) -> list[tuple[str, DataFrame, list[str]]]:
    """(title, rows, order) of a report's three blocks, for sinks/blocks: operators by sessions, pages and zone types by decisions."""
    done = F.col("confirmed") + F.col("corrected") + F.col("rejected")
    sums = [F.sum(c).alias(c) for c in ("reviewed", "active_ms", "confirmed", "corrected", "rejected")]
    per_hour = _tenths(F.when(F.col("active_ms") > 0, F.col("reviewed") * 3600000.0 / F.col("active_ms"))).alias("ZonesPerHour")
    people = sessions.groupBy("operator_id").agg(*sums, F.max("started_ms").alias("last"))
    people = people.select(F.col("operator_id").alias("Operator"), F.col("reviewed").alias("ZonesReviewed"), F.col("active_ms").alias("ActiveMs"), per_hour, *_shares(done), F.col("last").alias("LastActivity"))
    counts = [F.count_if(F.col("decision") == c.upper()).alias(c) for c in ("confirmed", "corrected", "rejected")]
    pages = decisions.groupBy(F.col("page_number").alias("Page")).agg(F.count("*").alias("Zones"), *[c.alias(n) for c, n in zip(counts, ("Confirmed", "Corrected", "Rejected"), strict=True)])
    kinds = decisions.groupBy("zone_type").agg(F.count("*").alias("total"), *counts)
    kinds = kinds.select(F.col("zone_type").alias("ZoneType"), F.col("total").alias("Total"), *[F.col(c).alias(c.capitalize()) for c in ("confirmed", "corrected", "rejected")], *_shares(F.col("total")))
    return [("Operator Breakdown", people, ["Operator"]), ("Page Breakdown", pages, ["Page"]), ("Zone Type Breakdown", kinds, ["ZoneType"])]
