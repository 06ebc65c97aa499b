"""Layout of pages: tables among blocks, column groups, heading sizes, captions, document scores, bounded tables of cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.labels import lookup
from tessella.functions.numbers import upper_median
from tessella.operators.kernels import Columns, per_group

#: Classes of structure tags; other tags are paragraphs, containers have none.
TAG_CLASSES = {"P": "paragraph", "H": "section-header", "H1": "section-header", "H2": "section-header", "H3": "section-header", "H4": "section-header", "H5": "section-header", "H6": "section-header", "Table": "table", "Figure": "figure", "Caption": "caption", "Note": "footnote", "LI": "list-item", "TOCI": "toci", "Formula": "formula"}
CONTAINERS = ("Document", "Part", "Art", "Sect", "Div", "L", "TOC", "NonStruct")


def tag_class(tag: Column, roles: dict[str, str] | None = None) -> Column:
    """The class of a structure tag, mapped roles first; null for containers."""
    t = F.coalesce(lookup(tag, roles), tag) if roles else tag
    return F.when(~t.isin(*CONTAINERS), F.coalesce(lookup(t, TAG_CLASSES), F.lit("paragraph")))


def table_candidates(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys (down to the block), rows, columns, header row and column; items: line, x, bold.

    A column is a place, rounded to tens, at which at least half as many items start as there are lines.
    """
    lines = items.groupBy(*keys).agg(F.countDistinct("line").alias("rows"), F.min("line").alias("top"))
    columns = items.groupBy(*keys, (F.floor(F.col("x") / 10 + 0.5) * 10).alias("at")).agg(F.count("*").alias("n")).join(lines, keys).where(F.col("n") >= F.col("rows") * 0.5).groupBy(*keys).agg(F.count("*").alias("columns"))
    first = items.groupBy(*keys, "line").agg(F.min_by("bold", "x").alias("first_bold"), F.bool_or("bold").alias("any_bold"))
    heads = first.join(lines, keys).groupBy(*keys).agg(F.bool_or((F.col("line") == F.col("top")) & F.col("any_bold")).alias("header_row"), F.bool_and("first_bold").alias("header_column"))
    return lines.join(columns, keys).join(heads, keys).where("rows >= 2 AND columns >= 2").select(*keys, "rows", "columns", "header_row", "header_column")


def column_groups(lines: DataFrame, keys: list[str], order: list[str], reach: float = 50.0, least: int = 3) -> DataFrame:
    """keys, group, n of page columns: a line joins the first group whose range, widened by reach, it meets, and widens it.

    Ranges grow as lines join, so a page's lines are walked in order.
    """

    def page(g: Columns) -> Columns:
        groups: list[list[float]] = []
        for lo, hi in zip(g["x"].tolist(), (g["x"] + g["w"]).tolist(), strict=True):
            for r in groups:
                if lo < r[1] + reach and hi > r[0] - reach:
                    r[0], r[1], r[2] = min(r[0], lo), max(r[1], hi), r[2] + 1
                    break
            else:
                groups.append([lo, hi, 1])
        n = np.array([r[2] for r in groups], np.int64)
        keep = np.flatnonzero(n >= least)
        return {"group_no": keep.astype(np.int64), "n": n[keep]}

    return per_group(lines, keys, order, ["x", "w"], page, {"group_no": "bigint", "n": "bigint"})


def reading_order_confidence(pages: DataFrame, key: str) -> DataFrame:
    """key, confidence, logical: 0.9 if tagged, else 0.5 less 0.2 for each page of several columns; in [0, 1]. pages: tagged, columns, ltr."""
    confused = F.sum(F.when(~F.col("tagged") & (F.col("columns") > 1), 1).otherwise(0))
    base = F.when(F.bool_or("tagged"), 0.9).otherwise(0.5)
    return pages.groupBy(key).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - confused * 0.2)).alias("confidence"), ((confused == 0) & (F.bool_or("tagged") | F.bool_and("ltr"))).alias("logical"))


def accessibility_score(c: dict[str, Column]) -> Column:
    """0 to 100 of a document: tagged, language, first_heading_missing, critical, major, minor, bad_tables, order_issues, logical, bad_links."""
    score = F.lit(100) - F.when(c["tagged"], 0).otherwise(30) - F.when(c["language"], 0).otherwise(10) - F.when(c["first_heading_missing"], 10).otherwise(0)
    score = score - c["critical"] * 15 - c["major"] * 5 - c["minor"] * 2 - c["bad_tables"] * 5 - c["order_issues"] * 5 - F.when(c["logical"], 0).otherwise(10) - F.least(c["bad_links"], F.lit(5)) * 2
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def nearest_heading_levels(zones: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """keys, ids, level of headings: the larger sizes of a document, above its middle one, are levels 1 to 6; the nearest decides, of two the larger."""
    sizes = zones.where("h > 0").select(*keys, "h").distinct()
    n = sizes.groupBy(*keys).agg(F.count("*").alias("n"), F.min("h").alias("least"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY h)").alias("mid"))
    by = Window.partitionBy(*keys).orderBy(F.desc("h"))
    ranked = sizes.join(n, keys).withColumn("r", F.row_number().over(by))
    body = ranked.where(F.col("r") == F.when(F.col("n") > 2, F.floor(F.col("n") / 2) + 1).otherwise(F.col("n"))).select(*keys, F.col("h").alias("body"))
    levels = ranked.join(body, keys).where((F.col("h") > F.col("body")) & (F.col("r") <= 6)).select(*keys, F.col("h").alias("size"), F.col("r").alias("level"))
    heads = zones.where("zone_type = 'section-header' AND h > 0").select(*keys, *ids, "h")
    return heads.join(levels, keys).groupBy(*keys, *ids).agg(F.min_by("level", F.struct(F.abs(F.col("size") - F.col("h")), "level")).alias("level"))


def absorb_captions(zones: DataFrame, keys: list[str], order: list[str], overlap: float = 0.3, gap: float = 1.5) -> DataFrame:
    """Regions of a page after captions have gone into figures: order columns, zone_type, box.

    A caption joins the nearest figure that it overlaps across by 30 % of the narrower and that is at most 1.5 of its
    heights away; the figure's box grows, which later captions see, so a page is walked in order.
    """

    def page(g: Columns) -> Columns:
        b = np.column_stack([g[c] for c in "xywh"]).astype(float)
        kind = g["zone_type"]
        figures = np.flatnonzero(kind == "figure")
        keep = np.ones(len(b), bool)
        for i in np.flatnonzero(kind == "caption"):
            if not len(figures):
                break
            x, y, w, h = b[i]
            f = b[figures]
            across = np.minimum(x + w, f[:, 0] + f[:, 2]) - np.maximum(x, f[:, 0])
            away = np.where(y + h <= f[:, 1], f[:, 1] - y - h, np.where(y >= f[:, 1] + f[:, 3], y - f[:, 1] - f[:, 3], 0.0))
            away = np.where((across >= np.minimum(w, f[:, 2]) * overlap) & (away <= h * gap), away, np.inf)
            k = int(away.argmin())
            if np.isfinite(away[k]):
                j = figures[k]
                low, high = np.minimum(b[j, :2], b[i, :2]), np.maximum(b[j, :2] + b[j, 2:], b[i, :2] + b[i, 2:])
                b[j] = [*low, *(high - low)]
                keep[i] = False
        return {**{c: g[c][keep] for c in order}, "zone_type": kind[keep], **{c: b[keep, n] for n, c in enumerate("xywh")}}

    out = {**{c: zones.schema[c].dataType.simpleString() for c in order}, "zone_type": "string", **dict.fromkeys("xywh", "double")}
    return per_group(zones, keys, order, [*order, "zone_type", *"xywh"], page, out)


def table_kinds(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, issues of tables; cells: row_no, header, scope, caption. layout: under two rows or columns; data: with headers; else unmarked."""
    rows = cells.groupBy(*keys, "row_no").agg(F.count("*").alias("n"), F.count_if("header").alias("headers"), F.count_if(F.col("header") & F.col("scope").isNull()).alias("bare"), F.max("caption").alias("caption"))
    t = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.max("n").alias("columns"), F.sum("headers").alias("headers"), F.sum("bare").alias("bare"), F.max("caption").alias("caption"))
    kind = F.when((F.col("rows") < 2) | (F.col("columns") < 2), "layout").when(F.col("headers") > 0, "data").otherwise("unmarked")
    issues = F.array(F.when(kind == "unmarked", "no-headers"), F.when((kind == "data") & (F.col("bare") > 0), "no-scope"), F.when((kind == "data") & F.col("caption").isNull(), "no-caption"))
    return t.select(*keys, kind.alias("kind"), F.array_join(F.filter(issues, lambda x: x.isNotNull()), ",").alias("issues"))


def usual_height(zones: DataFrame, keys: list[str]) -> DataFrame:
    return zones.groupBy(*keys).agg(upper_median("h").alias("usual"))
