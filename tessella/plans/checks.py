"""Objects and tables of tagged documents, rules as table functions, search of works, over views of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import pdf_objects as po
from tessella.operators import reference_search as rs
from tessella.operators import rule_functions as rf
from tessella.operators import timesheets as tim
from tessella.plans.content import _TOKENS
from tessella.plans.registry import query
from tessella.sources.tables import table, view

_BLANK = "coalesce(trim({}), '') = ''"
_OBJECT_RULES = {
    "19-003": f"kind = 'note' AND {_BLANK.format('id')}",
    "20-001": f"kind = 'layers' AND {_BLANK.format('name')}",
    "20-002": f"kind = 'default-layers' AND {_BLANK.format('name')}",
    "20-003": "kind LIKE '%layers' AND has_state",
    "21-001": "kind = 'attachment' AND coalesce(file_name, unicode_name) IS NULL",
    "25-001": "kind = 'form-config' AND contains(content, '>required<')",
    "26-001": "kind = 'encryption' AND permissions IS NULL",
    "26-002": "kind = 'encryption' AND (permissions // 512) % 2 = 0",
    "30-001": "kind = 'xobject' AND subtype = 'Reference'",
}


@query("re7c_document_objects", "WITH x AS (" + " UNION ALL ".join(f"SELECT doc, object, '{c}' AS code, 1 AS n FROM pdf_objects WHERE {r}" for c, r in _OBJECT_RULES.items()) + " UNION ALL SELECT doc, min(object), '19-004', count(*) FROM pdf_objects WHERE kind = 'note' AND trim(id) <> '' GROUP BY doc, id HAVING count(*) > 1) SELECT doc, object, code, CAST(n AS BIGINT) AS n FROM x", "pdf_objects")
def _(spark, d):
    return po.check_objects(view(spark, d, "pdf_objects"), ["doc"])


@query("re7d_structure_flags", "WITH f AS (SELECT p_partkey, p_size % 3 <> 0 AS tagged, p_size % 4 = 0 AS suspect, p_partkey % 7 <> 0 AS logical, p_partkey % 3 AS lists FROM part) SELECT p_partkey, '01-004' AS code FROM f WHERE tagged AND suspect UNION ALL SELECT p_partkey, '12-001' FROM f WHERE NOT logical UNION ALL SELECT p_partkey, 'LIST-NOT-TAGGED' FROM f WHERE NOT tagged AND lists > 0")
def _(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")
    files = table(spark, d, "part").select("p_partkey", (s % 3 != 0).alias("tagged"), (s % 4 == 0).alias("suspect"), (k % 7 != 0).alias("logical_order"), (k % 3).alias("lists"))
    return po.check_structure(files, ["p_partkey"])


_SIGNS = "CASE WHEN n_columns = 1 THEN 30 ELSE 0 END + CASE WHEN n_rows = 1 THEN 30 ELSE 0 END + CASE WHEN h THEN -40 ELSE 20 END + CASE WHEN n_rows <= 2 AND n_columns <= 2 AND NOT header_row THEN 15 ELSE 0 END - CASE WHEN summary IS NOT NULL THEN 50 ELSE 0 END - CASE WHEN n_rows >= 5 AND n_columns >= 3 THEN 20 ELSE 0 END >= 30"
_TABLE_RULES = {
    "15-005": "layout AND file_tagged",
    "15-001": "NOT layout AND file_tagged AND NOT tagged",
    "15-002": "NOT layout AND NOT h",
    "TABLE-HEADERS-INCOMPLETE": "NOT layout AND least(n_rows, n_columns) >= 5 AND header_row <> header_column",
    "15-004": "NOT layout AND file_tagged AND h AND greatest(n_rows, n_columns) > 3 AND NOT scoped",
    "15-003": "NOT layout AND irregular",
    "TABLE-MISSING-SUMMARY": "NOT layout AND summary IS NULL AND caption IS NULL AND greatest(n_rows, n_columns) >= 5",
}


@query("re7e_table_shapes", f"WITH h AS (SELECT *, header_row OR header_column AS h FROM pdf_tables), t AS (SELECT *, {_SIGNS} AS layout FROM h) " + " UNION ALL ".join(f"SELECT table_id, '{c}' AS code FROM t WHERE {r}" for c, r in _TABLE_RULES.items()), "pdf_tables")
def _(spark, d):
    return po.check_table_shapes(view(spark, d, "pdf_tables"), ["table_id"])


@query("re7f_table_facts", "WITH c AS (SELECT o1, o2, count(*) AS n, bool_and(detector = 'A') AS whole, arg_min(detector = 'A', o3 * 100000 + o4) AS first FROM zones GROUP BY 1, 2) SELECT o1, count(*) AS n_rows, max(n) AS n_columns, arg_min(whole, o2) AS header_row, bool_and(first) AS header_column, count(DISTINCT n) > 1 AS irregular FROM c GROUP BY 1", "zones")
def _(spark, d):
    cells = view(spark, d, "zones").selectExpr("o1", "o2 AS row_no", "o3 * 100000 + o4 AS column_no", "detector = 'A' AS header")
    return po.table_facts(cells, ["o1"])


_STYLE = {"comma-and": r",\s+and\b", "double-space": r"\.[ ]{2,}", "sentence-start": r"[.!?] [a-z]"}


@query("ud1_rule_function", " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '{p}')" for n, p in _STYLE.items()))
def _(spark, d):
    """Rules called from SQL beside LATERAL."""
    rf.register(spark, "style_check", {n: rf.by_pattern(p) for n, p in _STYLE.items()})
    return spark.sql("SELECT doc_id, rule, count(*) AS n FROM {docs}, LATERAL style_check(text) GROUP BY doc_id, rule", docs=table(spark, d, "documents"))


@query("ud1b_first_use", "WITH m AS (SELECT doc_id, regexp_extract_all(text, '\\(?\\b[A-Z]{2,6}\\b') AS m FROM documents), e AS (SELECT doc_id, ltrim(unnest(m), '(') AS term, unnest(m) AS seen, generate_subscripts(m, 1) AS pos FROM m), f AS (SELECT doc_id, term, arg_min(seen, pos) AS seen FROM e GROUP BY 1, 2) SELECT doc_id, term FROM f WHERE NOT starts_with(seen, '(')")
def _(spark, d):
    """Abbreviations whose first use in a document doesn't define them: a rule that looks back, over the lines of each document in order."""
    rf.register(spark, "first_use", {"abbr-first-use": rf.first_use(r"\b[A-Z]{2,6}\b")})
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines.createOrReplaceTempView("lines_of_documents")
    return spark.sql("SELECT doc_id, match AS term FROM first_use(TABLE(SELECT doc_id, line_no, line FROM lines_of_documents) PARTITION BY (doc_id) ORDER BY (line_no), 'line')")


_W = "floor(1000.0 * ln(1.0 + (works - df + 0.5) / (df + 0.5)) * (2.2 * tf) / (tf + 1.2 * (0.25 + 0.75 * (n * (works / \"all\")))))"


@query(
    "src14_reference_search",
    f"WITH t AS (SELECT item_id AS work, unnest({_TOKENS}) AS term FROM benchmark), c AS (SELECT work, term, CAST(count(*) AS DOUBLE) AS tf FROM t GROUP BY 1, 2), l AS (SELECT work, CAST(sum(tf) AS DOUBLE) AS n FROM c GROUP BY 1),"
    f' g AS (SELECT CAST(count(*) AS DOUBLE) AS works, sum(n) AS "all" FROM l), d AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM c GROUP BY 1), w AS (SELECT work, term, CAST({_W} AS BIGINT) AS w FROM c JOIN l USING (work) JOIN d USING (term), g),'
    f" q AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents), s AS (SELECT doc_id, work, CAST(sum(w) AS BIGINT) AS score FROM q JOIN w USING (term) GROUP BY 1, 2)"
    " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, work) AS rank, work, score FROM s QUALIFY rank <= 5",
)
def _(spark, d):
    index = rs.postings(table(spark, d, "benchmark"), "item_id", tx.tokenise(F.col("text")))
    return rs.search(table(spark, d, "documents"), "doc_id", tx.tokenise(F.col("text")), index)


def _tenths_sql(x: str) -> str:
    t = f"CAST(floor(({x}) * 10 + 0.5) AS BIGINT)"
    return f"({t} // 10) || '.' || ({t} % 10)"


def _shares_sql(total: str) -> str:
    return " || ',' || ".join(f"coalesce({_tenths_sql(f'{c} * 100.0 / nullif({total}, 0)')}, '')" for c in ("confirmed", "corrected", "rejected"))


@query(
    "snk8_three_blocks",
    "WITH p AS (SELECT operator_id, sum(reviewed) AS reviewed, sum(active_ms) AS active_ms, sum(confirmed) AS confirmed, sum(corrected) AS corrected, sum(rejected) AS rejected, max(started_ms) AS last FROM sessions GROUP BY 1),"
    " g AS (SELECT page_number, zone_type, count(*) AS n, count(*) FILTER (decision = 'CONFIRMED') AS confirmed, count(*) FILTER (decision = 'CORRECTED') AS corrected, count(*) FILTER (decision = 'REJECTED') AS rejected FROM decisions GROUP BY GROUPING SETS ((page_number), (zone_type))),"
    " l AS (SELECT 0 AS block, operator_id || ',' || reviewed || ',' || active_ms || ',' || coalesce(" + _tenths_sql("reviewed * 3600000.0 / nullif(active_ms, 0)") + ", '') || ',' || " + _shares_sql("(confirmed + corrected + rejected)") + " || ',' || last AS value FROM p"
    " UNION ALL SELECT 1, page_number || ',' || n || ',' || confirmed || ',' || corrected || ',' || rejected FROM g WHERE page_number IS NOT NULL"
    " UNION ALL SELECT 2, zone_type || ',' || n || ',' || confirmed || ',' || corrected || ',' || rejected || ',' || " + _shares_sql("n") + " FROM g WHERE zone_type IS NOT NULL"
    " UNION ALL VALUES (0, '# Operator Breakdown'), (0, 'Operator,ZonesReviewed,ActiveMs,ZonesPerHour,Confirm%,Correct%,Reject%,LastActivity'), (0, ''), (1, '# Page Breakdown'), (1, 'Page,Zones,Confirmed,Corrected,Rejected'), (1, ''), (2, '# Zone Type Breakdown'), (2, 'ZoneType,Total,Confirmed,Corrected,Rejected,Confirm%,Correct%,Reject%')) SELECT CAST(block AS INTEGER) AS block, value FROM l",
    "sessions decisions",
)
def _(spark, d):
    """The lines that write_report() puts into one file."""
    from tessella.sinks.blocks import report_lines

    return report_lines(tim.report_blocks(view(spark, d, "sessions"), view(spark, d, "decisions")))
