"""Whole audits over the template of operators/audits, and the levels of criteria."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import audits as aud
from tessella.plans.registry import query
from tessella.sources.tables import table, view

_LIST = {"AAA": ", ".join(f"'{c}'" for c in aud.LEVEL_AAA), "AA": ", ".join(f"'{c}'" for c in aud.LEVEL_AA)}
_LEVEL = "coalesce(list_filter([CASE WHEN c IN ({AAA}) THEN 'AAA' WHEN c IN ({AA}) THEN 'AA' END FOR c IN criteria], lambda x: x IS NOT NULL)[1], 'A')".format(**_LIST)
_PRINCIPLE = "CASE left(criteria[1], 1) WHEN '2' THEN 'Operable' WHEN '3' THEN 'Understandable' WHEN '4' THEN 'Robust' ELSE 'Perceivable' END"


@query(
    "sf27b_level_and_principle",
    "WITH c AS (SELECT issue_id, code, CASE WHEN issue_id % 7 = 0 THEN [] ELSE [(issue_id % 4 + 1) || '.' || (issue_id % 5 + 1) || '.' || (issue_id % 11 + 1), (file_id % 4 + 1) || '.' || (issue_id % 3 + 1) || '.' || (file_id % 9 + 1)] END AS criteria FROM issues)"
    f" SELECT issue_id, code, array_to_string(criteria, ',') AS criteria, {_LEVEL} AS level, {_PRINCIPLE} AS principle FROM c WHERE len(criteria) > 0",
    "issues",
)
def _(spark, d):
    """Issues of two criteria each, derived from their numbers; every seventh names none."""

    def criterion(*parts):
        return F.concat_ws(".", *[(F.expr(p) + 1).cast("string") for p in parts])

    two = F.array(criterion("issue_id % 4", "issue_id % 5", "issue_id % 11"), criterion("file_id % 4", "issue_id % 3", "file_id % 9"))
    named = F.when(F.col("issue_id") % 7 == 0, F.array().cast("array<string>")).otherwise(two)
    found = aud.criteria_of(view(spark, d, "issues").withColumn("criteria", named), ["issue_id"])
    return found.withColumn("criteria", F.array_join("criteria", ","))


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(h, '{pattern}'))"


_PAGE_ISSUES = (
    "h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),"
    " l AS (SELECT page_id, h, regexp_extract_all(h, '(?i)<h([1-6])\\b', 1) AS l FROM h),"
    " i AS (SELECT page_id, 'EPUB-SEM-001' AS code, 'serious' AS severity, 'A' AS level, CASE WHEN regexp_matches(h, '(?i)<html\\b[^>]*\\slang\\s*=') THEN 0 ELSE 1 END AS n FROM h"
    f" UNION ALL SELECT page_id, 'EPUB-SEM-002', 'moderate', 'A', {_n('(?is)<a\\b[^>]*>\\s*</a>')} FROM h"
    f" UNION ALL SELECT page_id, 'EPUB-IMG-001', 'critical', 'A', {_n('(?i)<img\\b[^>]*>')} - {_n('(?i)<img\\b[^>]*\\salt\\s*=[^>]*>')} FROM h"
    " UNION ALL SELECT page_id, 'EPUB-STRUCT-002', 'serious', 'A', CASE WHEN regexp_matches(h, '(?i)<table\\b') AND NOT regexp_matches(h, '(?i)<th\\b') THEN 1 ELSE 0 END FROM h"
    " UNION ALL SELECT page_id, 'EPUB-STRUCT-003', 'moderate', 'AA', least(1, len(list_filter(range(2, len(l) + 1), lambda i: CAST(l[i] AS INT) - CAST(l[i - 1] AS INT) > 1))) FROM l"
    " UNION ALL SELECT page_id, 'EPUB-STRUCT-004', 'minor', NULL, CASE WHEN regexp_matches(h, '(?i)<main\\b|role\\s*=\\s*[\"'']main[\"'']') THEN 0 ELSE 1 END FROM h)"
)
_COUNTS = ", ".join(f"coalesce(sum(n) FILTER (severity = '{s}'), 0) AS n_{s}" for s in aud.WEIGHTS)
_DEDUCTION = " + ".join(f"n_{s} * {w}" for s, w in aud.WEIGHTS.items())


@query(
    "ud3_page_audit",
    f"WITH {_PAGE_ISSUES}, s AS (SELECT page_id, {_COUNTS}, coalesce(sum(n), 0) AS n_issues, coalesce(string_agg(DISTINCT code, ',' ORDER BY code) FILTER (n > 0), '') AS codes, max(level) FILTER (n > 0) AS level FROM i GROUP BY 1)"
    f" SELECT CAST(page_id AS BIGINT) AS page_id, {', '.join(f'CAST(n_{s} AS BIGINT) AS n_{s}' for s in aud.WEIGHTS)}, CAST({_DEDUCTION} AS BIGINT) AS deduction, CAST(greatest(0, 100 - ({_DEDUCTION})) AS BIGINT) AS score, CAST(n_issues AS BIGINT) AS n_issues, codes, level, n_critical = 0 AND n_serious = 0 AS passed FROM s",
)
def _(spark, d):
    return aud.PageAudit("page_id").run(table(spark, d, "pages"))
