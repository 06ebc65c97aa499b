"""Tables of a folder, and proxy views over them.

A view is a list of SQL expressions that Spark and DuckDB read alike, so that a query and its check see the same rows.
MS(x) stands for a timestamp's milliseconds since 1970.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessella.functions.labels import CANONICAL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(expr: str, values: tuple) -> str:
    """CASE over the remainder of expr; null values stay null."""
    arms = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE ({expr}) % {len(values)} {arms} END"


_TYPE = _pick("l_partkey", CANONICAL)
_OTHER = _pick("l_partkey + l_suppkey", CANONICAL)

#: name -> (table, expressions)
VIEWS: dict[str, tuple[str, list[str]]] = {
    "zones": ("lineitem", [
        "l_orderkey AS o1", "l_linenumber AS o2", "l_partkey AS o3", "l_suppkey AS o4",
        "l_orderkey % 16 AS run_id", "l_orderkey % 97 + 1 AS page_number",
        "CAST((l_linenumber - 1) * 15 + l_partkey % 15 AS DOUBLE) AS x", "CAST((l_suppkey % 8) * 10 AS DOUBLE) AS y",
        "20 + l_quantity AS w", "CAST(10 + l_partkey % 20 AS DOUBLE) AS h",
        f"{_TYPE} AS zone_type", "CASE WHEN l_returnflag = 'A' THEN 'A' ELSE 'B' END AS detector",
        "l_discount * 10 AS confidence",
    ]),
    "decisions": ("lineitem", [
        "l_orderkey AS o1", "l_linenumber AS o2", "l_partkey AS o3", "l_suppkey AS o4",
        "l_orderkey % 16 AS run_id", "l_orderkey % 97 + 1 AS page_number", f"{_TYPE} AS zone_type",
        f"{_pick('l_partkey', ('CONFIRMED', 'CORRECTED', 'REJECTED', 'CONFIRMED', None))} AS decision",
        f"CASE WHEN l_partkey % 5 = 1 AND l_suppkey % 10 <> 0 THEN {_OTHER} END AS operator_label",
        f"{_pick('l_suppkey', ('auto-annotation', 'ai:v1', 'op1', 'op2', 'op3', None))} AS verified_by",
        f"CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber % 3 = 0 THEN {_OTHER} ELSE {_TYPE} END AS ai_label",
        f"{_pick('l_linenumber', ('CONFIRMED', 'CORRECTED', 'REJECTED', 'CONFIRMED'))} AS ai_decision",
        "l_discount * 10 AS ai_confidence",
        f"{_pick('l_suppkey', ('GREEN', 'AMBER', 'RED', 'GREEN', None))} AS bucket",
        f"{_TYPE} AS a_label", f"CASE WHEN l_linenumber = 6 THEN NULL WHEN l_suppkey % 4 = 0 THEN {_OTHER} ELSE {_TYPE} END AS b_label",
    ]),
    "sessions": ("orders", [
        "o_orderkey AS session_id", "'op' || CAST(o_custkey % 25 AS VARCHAR(9)) AS operator_id", "o_orderkey % 16 AS run_id", "o_orderdate AS started_at",
        "MS(o_orderdate) AS started_ms", "CASE WHEN o_orderstatus <> 'P' THEN MS(o_orderdate) + CAST(floor(o_totalprice * 20) AS BIGINT) END AS ended_ms",
        "CAST(floor(o_totalprice * 10) AS BIGINT) AS active_ms", "CAST(floor(o_totalprice * 3) AS BIGINT) AS idle_ms",
        "o_orderkey % 50 AS reviewed", "o_orderkey % 20 AS confirmed", "o_orderkey % 7 AS corrected", "o_orderkey % 3 AS rejected",
        "CASE WHEN o_orderpriority = '5-LOW' THEN 'blind' ELSE 'assisted' END AS mode",
    ]),
    "workflow_events": ("events", ["event_id", "user_id AS workflow_id", "event_type AS state", "MS(ts) AS ts_ms", "ts", "value"]),
    "issues": ("events", [
        "event_id AS issue_id", "user_id AS file_id", "'R' || CAST(event_id % 40 AS VARCHAR(9)) AS code", "event_id % 2 AS stage", "event_id % 3 AS source_no",
        "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'serious' WHEN 'signup' THEN 'moderate' ELSE 'minor' END AS severity",
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 30 END AS page", "'loc' || CAST(event_id % 11 AS VARCHAR(9)) AS location",
        "'message ' || CAST(event_id % 17 AS VARCHAR(9)) AS message", "MS(ts) AS ts_ms", "props", "event_type", "value",
    ]),
    "pdf_objects": ("lineitem", [
        "l_orderkey AS doc", "CAST(l_linenumber AS VARCHAR(9)) || '/' || CAST(l_partkey AS VARCHAR(9)) || '/' || CAST(l_suppkey AS VARCHAR(9)) AS object",
        f"{_pick('l_linenumber', ('note', 'layers', 'default-layers', 'attachment', 'form-config', 'encryption', 'xobject'))} AS kind",
        "CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'n' || CAST(l_suppkey % 2 AS VARCHAR(9)) END AS id",
        f"{_pick('l_partkey', ('Layer', ' ', None, 'Notes', 'Print'))} AS name", "l_suppkey % 3 = 0 AS has_state",
        "CASE WHEN l_partkey % 2 = 0 THEN 'a.txt' END AS file_name", "CASE WHEN l_suppkey % 2 = 0 THEN 'b.txt' END AS unicode_name",
        f"'<xfa><dynamicRender>' || {_pick('l_partkey', ('required', 'forbidden', 'optional'))} || '</dynamicRender></xfa>' AS content",
        "CASE WHEN l_partkey % 4 > 0 THEN CAST(l_partkey * 64 + l_suppkey AS BIGINT) END AS permissions", f"{_pick('l_suppkey', ('Form', 'Image', 'Reference'))} AS subtype",
    ]),
    "pdf_tables": ("orders", [
        "o_orderkey AS table_id", "o_orderkey % 4 <> 0 AS file_tagged", "o_custkey % 5 <> 0 AS tagged", "o_orderkey % 8 + 1 AS n_rows", "o_custkey % 7 + 1 AS n_columns",
        "o_orderkey % 5 < 3 AS header_row", "o_custkey % 3 = 0 AS header_column", "o_custkey % 2 = 0 AS scoped", "o_orderkey % 11 = 0 AS irregular",
        f"{_pick('o_custkey', (None, 'Totals', None))} AS summary", f"{_pick('o_orderkey', ('Table 1', None, None, None))} AS caption",
    ]),
}

_MS = re.compile(r"MS\((\w+)\)")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    spark_sql = [_MS.sub(r"unix_millis(CAST(\1 AS TIMESTAMP))", c).replace("VARCHAR(9)", "STRING") for c in columns]
    return table(spark, sf_dir, source).selectExpr(*spark_sql)


def view_sql(name: str) -> str:
    """The view as a DuckDB subquery's text, for WITH."""
    source, columns = VIEWS[name]
    return f"{name} AS (SELECT {', '.join(_MS.sub(r'(epoch_us(\1) // 1000)', c) for c in columns)} FROM {source})"
