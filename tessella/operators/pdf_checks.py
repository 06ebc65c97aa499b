"""Checks of tagged documents whose structure has been read into rows: files, elements, table cells, text runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import contrast_passes, contrast_ratio

#: Condition codes by what they look for.
CODES = {"untagged": "PDF-UNTAGGED", "identifier": "PDFUA-IDENTIFIER-MISSING", "language": "11-001", "title": "07-001", "alt": "13-004", "alt_quality": "ALT-TEXT-QUALITY", "alt_prefix": "ALT-TEXT-REDUNDANT-PREFIX", "headers": "15-003", "irregular": "15-005", "summary": "TABLE-MISSING-SUMMARY", "list": "LIST-IMPROPER-MARKUP", "bookmarks": "BOOKMARK-MISSING", "bookmarks_few": "BOOKMARK-INSUFFICIENT", "bookmark_text": "BOOKMARK-GENERIC-TEXT", "field_label": "FORM-FIELD-NO-LABEL", "field_tip": "FORM-FIELD-MISSING-TOOLTIP", "formula": "FORMULA-MISSING-ACTUALTEXT", "contrast": "COLOR-CONTRAST", "link_text": "LINK-GENERIC-TEXT"}
GENERIC_LINKS = ("click here", "here", "read more", "more", "link", "this")
GENERIC_BOOKMARKS = r"(?i)^(untitled|bookmark|section|page)\s*\d*$"


def _issues(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    rows = F.array(*[F.when(c, F.lit(CODES[k])) for k, c in rules.items()])
    return df.select(*keys, F.explode(rows).alias("code")).where("code IS NOT NULL")


def check_files(files: DataFrame, key: str) -> DataFrame:
    """files: tagged, pdfua, language, title, pages, bookmarks (their number). Bookmarks are due from ten pages on, one for ten."""
    long = F.col("pages") >= 10
    return _issues(files, [key], {
        "untagged": ~F.coalesce("tagged", F.lit(False)),
        "identifier": ~F.coalesce("pdfua", F.lit(False)),
        "language": F.coalesce(F.trim("language"), F.lit("")) == "",
        "title": F.coalesce(F.trim("title"), F.lit("")) == "",
        "bookmarks": long & (F.coalesce("bookmarks", F.lit(0)) == 0),
        "bookmarks_few": long & (F.col("bookmarks") > 0) & (F.col("bookmarks") < F.col("pages") / 10),
    })


def check_elements(elements: DataFrame, keys: list[str]) -> DataFrame:
    """elements: kind (figure, formula, link, field, bookmark, list-item), alt, actual_text, text, tooltip, parent_kind."""
    kind, alt, text = F.col("kind"), F.coalesce(F.trim("alt"), F.lit("")), F.lower(F.coalesce(F.trim("text"), F.lit("")))
    return _issues(elements, keys, {
        "alt": (kind == "figure") & (alt == ""),
        "alt_quality": (kind == "figure") & (alt != "") & ((F.char_length(alt) < 5) | alt.rlike(r"(?i)\.(jpe?g|png|gif|tiff?)$")),
        "alt_prefix": (kind == "figure") & alt.rlike(r"(?i)^(image|picture|photo|graphic) of\b"),
        "formula": (kind == "formula") & (F.coalesce(F.trim("actual_text"), F.lit("")) == "") & (alt == ""),
        "link_text": (kind == "link") & text.isin(*GENERIC_LINKS),
        "field_label": (kind == "field") & (text == ""),
        "field_tip": (kind == "field") & (F.coalesce(F.trim("tooltip"), F.lit("")) == ""),
        "bookmark_text": (kind == "bookmark") & text.rlike(GENERIC_BOOKMARKS),
        "list": (kind == "list-item") & (F.coalesce("parent_kind", F.lit("")) != "list"),
    })


def check_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, code of tables; cells: row_no, header, summary. No header cell, rows of unlike lengths, no summary."""
    rows = cells.groupBy(*keys, "row_no").agg(F.count("*").alias("n"), F.bool_or("header").alias("header"), F.max("summary").alias("summary"))
    tables = rows.groupBy(*keys).agg(F.countDistinct("n").alias("lengths"), F.bool_or("header").alias("header"), F.max("summary").alias("summary"))
    return _issues(tables, keys, {"headers": ~F.coalesce("header", F.lit(False)), "irregular": F.col("lengths") > 1, "summary": F.coalesce(F.trim("summary"), F.lit("")) == ""})


def check_contrast(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ratio, code of text runs (fg, bg as #rrggbb, size, bold) under the AA threshold; large: 18 points, or 14 bold."""
    large = (F.col("size") >= 18) | ((F.col("size") >= 14) & F.coalesce("bold", F.lit(False)))
    ratio = contrast_ratio(F.col("fg"), F.col("bg"))
    return runs.withColumn("ratio", ratio).where(~contrast_passes(F.col("ratio"), large)["passes_aa"]).select(*keys, "ratio", F.lit(CODES["contrast"]).alias("code"))
