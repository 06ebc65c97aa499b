"""Training sets: splits, label lines, model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.geometry import box, normalised_centre
from tessella.functions.labels import CANONICAL, canonical, final_label
from tessella.functions.numbers import half_up


def page_split(document: Column, page: Column, train: int = 800, val: int = 100) -> Column:
    """train, val or test by the hash of document and page: a page keeps its side whatever else is exported."""
    m = F.conv(F.substring(F.md5(F.concat(document, F.lit(":"), page.cast("string"))), 1, 8), 16, 10).cast("long") % 1000
    return F.when(m < train, "train").when(m < train + val, "val").otherwise("test")


def stratified_split(docs: DataFrame, strata: list[str], order: list[str], train: float = 0.8, val: float = 0.1) -> DataFrame:
    """docs + split: within each stratum the first rows in order train, then val, then test."""
    i = F.row_number().over(Window.partitionBy(*strata).orderBy(*order)) - 1
    n = F.count("*").over(Window.partitionBy(*strata))
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(val))
    return docs.withColumn("split", F.when(i < a, "train").when(i < a + b, "val").otherwise("test"))


def training_lines(zones: DataFrame, width: float, height: float) -> DataFrame:
    """run_id, page_number, split, line: class index and normalised centre and size, six decimals; unknown labels go."""
    n = normalised_centre(box(), F.lit(width), F.lit(height))
    index = F.array_position(F.array(*[F.lit(c) for c in CANONICAL]), canonical(F.col("zone_type"))) - 1
    line = F.format_string("%d %.6f %.6f %.6f %.6f", index, n["cx"], n["cy"], n["cw"], n["ch"])
    split = page_split(F.col("run_id").cast("string"), F.col("page_number"))
    return zones.where(canonical(F.col("zone_type")).isNotNull()).select("run_id", "page_number", split.alias("split"), line.alias("line"))


def model_delta(base: DataFrame, new: DataFrame, step: float = 0.005, worst: float = -0.02) -> DataFrame:
    """One row: mean change of AP, the worst class, PROCEED where the mean gains `step` and no class loses more than `worst`."""
    domain = base.sparkSession.createDataFrame([(c,) for c in CANONICAL], "zone_type string")
    a, b = base.select("zone_type", F.col("ap").alias("was")), new.select("zone_type", F.col("ap").alias("is"))
    d = domain.join(a, "zone_type", "left").join(b, "zone_type", "left").fillna(0.0, ["was", "is"]).withColumn("delta", F.col("is") - F.col("was"))
    out = d.agg(half_up(F.avg("delta"), 4).alias("mean_delta"), half_up(F.min("delta"), 4).alias("worst_delta"), F.min_by("zone_type", F.struct("delta", "zone_type")).alias("worst_class"))
    return out.withColumn("recommendation", F.when((F.col("mean_delta") >= step) & (F.col("worst_delta") >= worst), "PROCEED").otherwise("HOLD"))


def lineage(zones: DataFrame, run: str, page: str, order: list[str]) -> DataFrame:
    """zones + zone_index (from 0 in each run, by page and order), human_label, final_label.

    Rows are numbered within their page, and pages start where those before them end, so that no task holds a run.
    zones: run, page, zone_type, operator_label, decision. A null page comes first.
    """
    d = F.col("decision")
    by_page = zones.groupBy(run, page).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(run).orderBy(page).rowsBetween(Window.unboundedPreceding, -1))
    starts = by_page.select(F.col(run).alias("_run"), F.col(page).alias("_page"), F.coalesce(before, F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy(run, page).orderBy(*order)) - 1
    placed = zones.withColumn("_nth", nth).join(starts, F.col(run).eqNullSafe(F.col("_run")) & F.col(page).eqNullSafe(F.col("_page")))
    human = F.when(d == "CORRECTED", F.col("operator_label")).when(d == "CONFIRMED", F.col("zone_type"))
    out = placed.withColumns({"zone_index": F.col("_start") + F.col("_nth"), "human_label": human, "final_label": final_label(d, F.col("zone_type"), F.col("operator_label"))})
    return out.drop("_nth", "_run", "_page", "_start")
