"""Removal of lines that spread over many sites: HyperLogLog by line hash, exact counts near the threshold. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_SITES, LG_K = 8, 10
#: Up to so many boilerplate lines and characters of them are sent to the texts; with more, lines are joined with them.
SENT_LINES, SENT_CHARS = 2000, 1 << 20


def _lines(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """keep and a row for each line that isn't blank; l: the line without blanks at its ends, line: its hash."""
    kept = docs.select(*keep, F.explode(F.split(common.text_of(text_col), "\n")).alias("l"))
    return kept.withColumn("l", F.trim("l")).where("l <> ''").withColumn("line", F.xxhash64("l"))


def _spread(lines: DataFrame, key: str, least: float, lg_k: int) -> DataFrame:
    """key, sites (estimated) of what stands on `least` sites or more. Tasks sketch their own rows, sketches merge by key."""
    return lines.groupBy(key).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites")).where(F.col("sites") >= least)


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source", lg_k: int = LG_K) -> DataFrame:
    """(l, sites): lines on min_sites distinct sites or more; sites is exact near the threshold, else estimated.

    Sketches of the sites of a line hash merge by aggregation. Of hashes that may spread far enough the lines themselves
    are read, so that lines of one hash are told apart. An estimate has a standard error of 1.04 / sqrt(2 ** lg_k), 3 %;
    lines estimated within a quarter of the threshold, over seven such errors, are counted exactly. A null site is a site
    of its own. Copies of a text on many sites spread like any other lines. An empty table has no such lines.
    """
    site = F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site")
    lines = _lines(docs, text_col, site)
    wide = common.materialize(_spread(lines.select("line", "site"), "line", min_sites * 0.75, lg_k).select("line"), "wide")
    spread = common.materialize(_spread(lines.join(wide, "line", "left_semi").select("l", "site"), "l", min_sites * 0.75, lg_k), "spread")
    near = spread.where(F.col("sites") <= min_sites * 1.25).select("l", F.xxhash64("l").alias("line"))
    # Sites are counted one by one only for lines near the threshold: what is kept of them grows with lines and sites, not with copies.
    # Their hashes find them first, as a table of numbers is soon small enough to be sent to the lines.
    few = lines.join(common.materialize(near.select("line").distinct(), "near"), "line", "left_semi").join(near.select("l"), "l", "left_semi")
    exact = few.select("l", "site").distinct().groupBy("l").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return spread.where(F.col("sites") > min_sites * 1.25).unionByName(exact)


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """doc_id, text (without boilerplate lines), n_lines (not blank), n_removed of every row of docs.

    Kept lines stay as they are, blank ones too, in order. Null text counts as empty. Rows that repeat a doc_id keep
    their own texts. A text whose lines are all boilerplate becomes empty; an empty table gives no rows.
    """
    found = common.materialize(boilerplate(docs, min_sites, text_col, site_col).select("l"), "boilerplate")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.split(common.text_of(text_col), "\n").alias("lines"))
    n, chars = found.agg(F.count("*"), F.coalesce(F.sum(F.length("l")), F.lit(0))).first()
    full = F.size(F.filter("lines", lambda line: F.trim(line) != "")).cast("long")
    if n <= SENT_LINES and chars <= SENT_CHARS:
        gone = [r[0] for r in found.collect()]
        kept = F.filter("lines", lambda line: ~F.trim(line).isin(gone)) if gone else F.col("lines")
        removed = F.size("lines") - F.size(kept)
        return rows.select("doc_id", F.array_join(kept, "\n").alias("text"), full.alias("n_lines"), removed.cast("long").alias("n_removed"))
    each = rows.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", full.alias("n_lines"), F.posexplode("lines").alias("at", "line"))
    each = each.join(found.withColumn("gone", F.lit(True)), F.trim("line") == F.col("l"), "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.struct("at", "line"))))
    back = each.groupBy("row", "doc_id", "n_lines").agg(kept.alias("kept"), F.count("gone").alias("n_removed"))
    return back.select("doc_id", F.array_join(F.transform("kept", lambda x: x["line"]), "\n").alias("text"), "n_lines", "n_removed")
