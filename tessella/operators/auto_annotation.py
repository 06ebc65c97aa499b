"""Structure of pages: page types, containers, heading levels, and the ordered patterns that decide regions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.labels import by_machine
from tessella.operators.kernels import Columns, per_group


def page_types(zones: DataFrame, last_page: int) -> DataFrame:
    """run_id, page_number, page_type for pages 1 to last_page, pages without regions included."""
    pages = zones.select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(last_page).cast("long"))).alias("page_number"))
    counts = zones.groupBy("run_id", "page_number").agg(F.count("*").alias("n"), F.count_if(F.col("zone_type") == "figure").alias("f"), F.count_if(F.col("zone_type") == "toci").alias("t"))
    n, f, t = F.col("n"), F.col("f"), F.col("t")
    kind = F.when(n == 0, "blank").when(f * 2 >= n, "figure").when(t * 2 >= n, "contents").when(n < 3, "sparse").otherwise("body")
    return pages.join(counts, ["run_id", "page_number"], "left").fillna(0, ["n", "f", "t"]).select("run_id", "page_number", kind.alias("page_type"))


def containers(zones: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, kind, items: runs of adjacent list items or contents entries."""
    by = Window.partitionBy(*keys).orderBy(*order)
    z = zones.withColumn("kind", F.when(F.col("zone_type").isin("list-item", "toci"), F.col("zone_type")))
    z = z.withColumn("_new", F.when(F.col("kind").eqNullSafe(F.lag("kind").over(by)), 0).otherwise(1))
    z = z.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return z.where("kind IS NOT NULL").groupBy(*keys, "_island", "kind").agg(F.count("*").alias("items")).drop("_island")


def heading_levels(headings: DataFrame, keys: list[str], order: list[str], tolerance: float = 0.15, deepest: int = 6) -> DataFrame:
    """keys, order columns, level: heights fall into bands, each from its tallest down by tolerance; then no level is skipped in order.

    Both steps depend on what they gave before, so a document's headings are walked in order.
    """

    def walk(g: Columns) -> Columns:
        level, top, of = 0, None, {}
        for h in sorted(set(g["h"].tolist()), reverse=True):
            if top is None or h < top * (1 - tolerance):
                level, top = level + 1, h
            of[h] = min(level, deepest)
        before, out = 0, []
        for h in g["h"].tolist():
            before = min(of[h], before + 1)
            out.append(before)
        return {**{c: g[c] for c in order}, "level": np.array(out, np.int32)}

    fields = {c: headings.schema[c].dataType.simpleString() for c in order}
    return per_group(headings, keys, order, [*order, "h"], walk, {**fields, "level": "int"})


def annotate(zones: DataFrame, page_height: float = 100.0) -> DataFrame:
    """zones + pattern, decision_out: ten patterns in order, each over what the earlier ones left open. Human decisions stay."""
    open_ = F.col("pattern").isNull() & (F.col("decision").isNull() | by_machine(F.col("verified_by")))
    z = zones.withColumn("pattern", F.lit(None).cast("string")).withColumn("decision_out", F.col("decision"))
    page = Window.partitionBy("run_id", "page_number")

    def apply(df: DataFrame, name: str, condition, decision: str) -> DataFrame:
        hit = open_ & F.coalesce(condition, F.lit(False))
        return df.withColumns({"pattern": F.when(hit, name).otherwise(F.col("pattern")), "decision_out": F.when(hit, decision).otherwise(F.col("decision_out"))})

    def on_page(kind: str):
        return F.count_if(open_ & (F.col("zone_type") == kind)).over(page)

    z = apply(z, "ghost", (F.col("w") < 25) & (F.col("h") < 12), "REJECTED")
    z = apply(z, "contents", (F.col("zone_type") == "toci") & (on_page("toci") >= 3), "CONFIRMED")
    z = apply(z, "footer", (F.col("bucket") == "RED") & (F.col("zone_type") == "footer") & (F.col("y") > 0.6 * page_height), "CONFIRMED")
    z = apply(z, "header", (F.col("bucket") == "RED") & (F.col("zone_type") == "header") & (F.col("y") < 0.2 * page_height), "CONFIRMED")
    z = apply(z, "running-header", (F.col("zone_type") == "header") & (F.col("y") == 0), "CONFIRMED")
    z = apply(z, "list-sequence", (F.col("zone_type") == "list-item") & (on_page("list-item") >= 3), "CONFIRMED")
    spot = Window.partitionBy("run_id", "page_number", "zone_type", "x", "y").orderBy("o1", "o2", "o3", "o4")
    z = apply(z, "duplicate-figure", (F.col("zone_type") == "figure") & (F.row_number().over(spot) > 1), "REJECTED")
    z = apply(z, "figure-agreed", (F.col("zone_type") == "figure") & (F.col("a_label") == F.col("b_label")), "CONFIRMED")
    z = apply(z, "section-header", (F.col("zone_type") == "section-header") & (F.col("h") >= 20), "CONFIRMED")
    return apply(z, "green", F.col("bucket") == "GREEN", "CONFIRMED")
