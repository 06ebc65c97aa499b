"""Lines of exported files and seeded samples, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import export as exp
from tessella.operators import relational as rel
from tessella.plans.annotation import FINAL
from tessella.plans.registry import query
from tessella.sinks import files
from tessella.sources.tables import view


def _quoted(c: str) -> str:
    s = f"coalesce(CAST({c} AS VARCHAR), '')"
    return f"CASE WHEN regexp_matches({s}, '[\",\\n]') THEN '\"' || replace({s}, '\"', '\"\"') || '\"' ELSE {s} END"


_LINE = " || ',' || ".join(_quoted(c) for c in files.LINEAGE.values())


@query(
    "snk9_lineage_lines",
    "WITH r AS (SELECT run_id, strftime(make_timestamp(max(ended_ms) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS completed_at FROM sessions GROUP BY 1),"
    " z AS (SELECT run_id, 'title ' || run_id || ', scanned' AS document, completed_at, page_number, o1 || '-' || o2 || '-' || o3 || '-' || o4 AS zone_id, row_number() OVER (PARTITION BY run_id ORDER BY page_number, o1, o2, o3, o4, ai_confidence) - 1 AS zone_index, a_label, b_label, bucket, ai_decision, ai_label,"
    " printf('%.3f', CAST(ai_confidence AS DOUBLE)) AS ai_confidence, decision, CASE decision WHEN 'CORRECTED' THEN operator_label WHEN 'CONFIRMED' THEN zone_type END AS human_label, verified_by, " + FINAL + " AS final_label FROM decisions JOIN r USING (run_id))"
    f" SELECT completed_at, run_id, zone_index, {_LINE} AS value FROM z",
    "sessions decisions",
)
def _(spark, d):
    """Lines of every zone, by run; a run ends with its last session."""
    done = view(spark, d, "sessions").groupBy("run_id").agg(F.date_format(F.timestamp_millis(F.max("ended_ms")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("completed_at"))
    zones = exp.lineage(view(spark, d, "decisions"), "run_id", "page_number", ["o1", "o2", "o3", "o4", "ai_confidence"])
    named = zones.withColumns({"document": F.format_string("title %d, scanned", "run_id"), "zone_id": F.concat_ws("-", "o1", "o2", "o3", "o4")})
    return files.lineage_lines(named.join(done, "run_id"))


@query("xs2_seeded_pages")
def _(spark, d):
    """Thirty pages up to 90 of each run's, by the seeded shuffle; the sample is the feature."""
    return rel.seeded_sample(view(spark, d, "zones"), ["run_id"], "page_number", 30, 42, most=90)
