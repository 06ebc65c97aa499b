"""Checks of tagged documents' objects (notes, layers, attachments, forms, encryption), structure flags and tables, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Condition codes by what they look for.
NOTE_ID, NOTE_ID_TWICE, LAYER_NAME, DEFAULT_LAYER_NAME, LAYER_STATE = "19-003", "19-004", "20-001", "20-002", "20-003"
FILE_NAME, DYNAMIC_FORM, PERMISSIONS, NO_EXTRACTION, REFERENCE_OBJECT = "21-001", "25-001", "26-001", "26-002", "30-001"
SUSPECT, READING_ORDER, LIST_UNTAGGED = "01-004", "12-001", "LIST-NOT-TAGGED"
TABLE_UNTAGGED, NO_HEADERS, IRREGULAR, NO_SCOPE, LAYOUT_TABLE = "15-001", "15-002", "15-003", "15-004", "15-005"
ONE_HEADER, NO_SUMMARY = "TABLE-HEADERS-INCOMPLETE", "TABLE-MISSING-SUMMARY"
#: Fixed value: the permission to extract text for assistive technology, bit 10.
EXTRACTION = 512


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _found(df: DataFrame, keep: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """keep + code: a row for each rule whose condition holds; an unknown condition doesn't."""
    codes = F.filter(F.array(*[F.when(c, F.lit(code)) for code, c in rules]), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(codes).alias("code"))


def check_objects(objects: DataFrame, keys: list[str]) -> DataFrame:
    """keys, object, code, n of a document's objects; keys name the document, nulls in them are a document of their own.

    objects: kind and what that kind has: note (id), layers and default-layers (name, has_state), attachment (file_name,
    unicode_name), form-config (content), encryption (permissions), xobject (subtype); object is its place or name.
    Layers need names and no automatic state, attachments one of both names, forms no dynamic rendering, encryption its
    permissions with the one to extract text; reference objects are not allowed; a kind that isn't listed gives nothing.
    n: 1, or how many notes of a document share an id, once for that id (its smallest object).
    """
    kind = F.col("kind")
    layers = kind.isin("layers", "default-layers")
    one = _found(objects, [*keys, "object"], [
        (NOTE_ID, (kind == "note") & _blank("id")),
        (LAYER_NAME, (kind == "layers") & _blank("name")),
        (DEFAULT_LAYER_NAME, (kind == "default-layers") & _blank("name")),
        (LAYER_STATE, layers & F.col("has_state")),
        (FILE_NAME, (kind == "attachment") & F.col("file_name").isNull() & F.col("unicode_name").isNull()),
        (DYNAMIC_FORM, (kind == "form-config") & F.col("content").rlike(r"<dynamicRender>\s*required\s*</dynamicRender>")),
        (PERMISSIONS, (kind == "encryption") & F.col("permissions").isNull()),
        (NO_EXTRACTION, (kind == "encryption") & (F.col("permissions").bitwiseAND(EXTRACTION) == 0)),
        (REFERENCE_OBJECT, (kind == "xobject") & (F.col("subtype") == "Reference")),
    ])
    notes = objects.where((kind == "note") & ~_blank("id"))
    twice = notes.groupBy(*keys, "id").agg(F.count("*").alias("n"), F.min("object").alias("object")).where("n > 1")
    return one.withColumn("n", F.lit(1).cast("long")).unionByName(twice.select(*keys, "object", F.lit(NOTE_ID_TWICE).alias("code"), "n"))


def check_structure(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, code; files: tagged, suspect, logical_order (booleans), lists (their number). Null tags are none, other nulls tell nothing."""
    tagged = F.coalesce("tagged", F.lit(False))
    return _found(files, keys, [(SUSPECT, tagged & F.col("suspect")), (READING_ORDER, ~F.col("logical_order")), (LIST_UNTAGGED, ~tagged & (F.col("lists") > 0))])


def table_facts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_rows, n_columns (of the longest row), header_row, header_column, irregular of tables of cells: row_no, column_no, header.

    A header row is a first row of header cells only, a header column is rows that all begin with one; a table is
    irregular where rows differ in length. Aggregates only, so a table may be of any size.
    """
    header = F.coalesce("header", F.lit(False))
    rows = cells.groupBy(*keys, "row_no").agg(F.count("*").alias("n"), F.bool_and(header).alias("whole"), F.min_by(header, "column_no").alias("first"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.max("n").alias("n_columns"), F.min_by("whole", "row_no").alias("header_row"), F.bool_and("first").alias("header_column"), (F.min("n") != F.max("n")).alias("irregular"))


def layout_score(rows: Column, columns: Column, header_row: Column, header_column: Column, summary: Column) -> Column:
    """How much a table looks like layout; from 30 on it counts as such."""
    headers = header_row | header_column
    # fmt: off
    #: Points by sign.
    signs = (
        (columns == 1, 30), (rows == 1, 30), (~headers, 20), ((rows <= 2) & (columns <= 2) & ~header_row, 15),
        (headers, -40), (summary, -50), ((rows >= 5) & (columns >= 3), -20),
    )
    # fmt: on
    score = F.lit(0)
    for sign, points in signs:
        score = score + F.when(sign, points).otherwise(0)
    return score


def check_table_shapes(tables: DataFrame, keys: list[str], layout_from: int = 30) -> DataFrame:
    """keys, code; tables: file_tagged, tagged, n_rows, n_columns, header_row, header_column, scoped, irregular, summary, caption.

    Tables of layout get LAYOUT_TABLE in tagged files and nothing else. Null flags are false, but an unknown `tagged` or
    `scoped` tells nothing; a blank summary or caption is none.
    """
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("file_tagged", "header_row", "header_column", "irregular")}
    t = tables.withColumns({**flags, "_summary": ~_blank("summary")})
    rows, columns, top, side, file_tagged = (F.col(c) for c in ("n_rows", "n_columns", "header_row", "header_column", "file_tagged"))
    layout = layout_score(rows, columns, top, side, F.col("_summary")) >= layout_from
    return _found(t, keys, [
        (LAYOUT_TABLE, layout & file_tagged),
        (TABLE_UNTAGGED, ~layout & file_tagged & ~F.col("tagged")),
        (NO_HEADERS, ~layout & ~top & ~side),
        (ONE_HEADER, ~layout & (rows >= 5) & (columns >= 5) & (top != side)),
        (NO_SCOPE, ~layout & file_tagged & (top | side) & ((rows > 3) | (columns > 3)) & ~F.col("scoped")),
        (IRREGULAR, ~layout & F.col("irregular")),
        (NO_SUMMARY, ~layout & ~F.col("_summary") & _blank("caption") & ((rows >= 5) | (columns >= 5))),
    ])
