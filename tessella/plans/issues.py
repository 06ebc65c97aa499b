"""Issue scores, clusters, comparisons, criteria and conformance over the issue view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.numbers import half_up, pct
from tessella.operators import codes
from tessella.operators import issues as iss
from tessella.operators import relational as rel
from tessella.plans.registry import js, query
from tessella.sources.tables import table, view

_POINTS = "CASE severity WHEN 'critical' THEN 15 WHEN 'serious' THEN 8 WHEN 'moderate' THEN 4 ELSE 1 END"
_RULES = "rules AS (SELECT 'R' || i AS code, unnest(['1.' || (i % 4 + 1) || '.' || (i % 3 + 1), '2.' || (i % 5 + 1) || '.1']) AS criterion FROM generate_series(0, 39) t(i))"
_CONF = "CASE WHEN sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) > count(*) * 0.3 THEN 'Does Not Support' WHEN sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) > 0 THEN 'Partially Supports' ELSE 'Supports' END"


def _rules(spark):
    i = spark.range(40).select(F.concat(F.lit("R"), F.col("id").cast("string")).alias("code"), F.array(F.concat_ws(".", F.lit("1"), (F.col("id") % 4 + 1).cast("string"), (F.col("id") % 3 + 1).cast("string")), F.concat_ws(".", F.lit("2"), (F.col("id") % 5 + 1).cast("string"), F.lit("1"))).alias("c"))
    return i.select("code", F.explode("c").alias("criterion"))


def _conformance(spark, d):
    """file_id, criterion, conformance."""
    n = view(spark, d, "issues").join(F.broadcast(_rules(spark)), "code").groupBy("file_id", "criterion")
    critical = F.count_if(F.col("severity") == "critical")
    return n.agg(F.when(critical > F.count("*") * 0.3, "Does Not Support").when(critical > 0, "Partially Supports").otherwise("Supports").alias("conformance"))


_CONF_CTE = f"{_RULES}, conf AS (SELECT file_id, criterion, {_CONF} AS conformance FROM issues JOIN rules USING (code) GROUP BY 1, 2)"


@query("ag44_severity_score", f"SELECT file_id, stage, CAST(greatest(0, 100 - sum({_POINTS})) AS BIGINT) AS score, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'serious') AS n_serious, count(*) FILTER (severity = 'moderate') AS n_moderate, count(*) FILTER (severity = 'minor') AS n_minor FROM issues GROUP BY 1, 2", "issues")
def _(spark, d):
    return iss.scores(view(spark, d, "issues"), ["file_id", "stage"])


_RW = "CASE rule_severity WHEN 'error' THEN 10 WHEN 'warning' THEN 3 ELSE 1 END"
_RES = "r AS (SELECT file_id, issue_id % 5 <> 0 AS passed, CASE WHEN issue_id % 3 = 0 THEN 'error' WHEN issue_id % 3 = 1 THEN 'warning' ELSE 'info' END AS rule_severity FROM issues)"


def _results(spark, d):
    i = F.col("issue_id")
    return view(spark, d, "issues").select("file_id", (i % 5 != 0).alias("passed"), F.when(i % 3 == 0, "error").when(i % 3 == 1, "warning").otherwise("info").alias("rule_severity"))


@query("ag45_weighted_pass_score", f"WITH {_RES}, s AS (SELECT file_id, {js(f'sum(CASE WHEN passed THEN {_RW} ELSE 0 END) * 100.0 / sum({_RW})', 2)} AS score FROM r GROUP BY 1) SELECT *, CASE WHEN score >= 95 THEN 'excellent' WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS level FROM s", "issues")
def _(spark, d):
    return iss.pass_scores(_results(spark, d), ["file_id"])


@query("ag46_pass_rate_conformance", f"WITH {_RES}, s AS (SELECT file_id, {js('count(*) FILTER (passed) * 100.0 / count(*)', 1)} AS pass_rate FROM r GROUP BY 1) SELECT *, CASE WHEN pass_rate >= 100 THEN 'Supports' WHEN pass_rate >= 25 THEN 'Partially Supports' ELSE 'Does Not Support' END AS conformance FROM s", "issues")
def _(spark, d):
    return iss.pass_rate_conformance(_results(spark, d), ["file_id"])


@query("ag47_batch_conservative", f"WITH {_CONF_CTE} SELECT criterion, CASE WHEN bool_or(conformance = 'Does Not Support') THEN 'Does Not Support' WHEN bool_or(conformance = 'Partially Supports') THEN 'Partially Supports' ELSE 'Supports' END AS conformance FROM conf GROUP BY 1", "issues")
def _(spark, d):
    return iss.batch_conformance(_conformance(spark, d), "criterion")


@query("ag47b_batch_optimistic", f"WITH {_CONF_CTE} SELECT criterion, CASE WHEN count(*) FILTER (conformance = 'Supports') * 2 >= count(*) THEN 'Supports' WHEN bool_or(conformance <> 'Does Not Support') THEN 'Partially Supports' ELSE 'Does Not Support' END AS conformance FROM conf GROUP BY 1", "issues")
def _(spark, d):
    return iss.batch_conformance(_conformance(spark, d), "criterion", "optimistic")


@query("ag48_dense_criteria", f"WITH {_CONF_CTE} SELECT f.file_id, c.criterion, coalesce(conformance, 'Supports') AS conformance FROM (SELECT DISTINCT file_id FROM issues) f CROSS JOIN (SELECT DISTINCT criterion FROM rules) c LEFT JOIN conf USING (file_id, criterion)", "issues")
def _(spark, d):
    files, criteria = view(spark, d, "issues").select("file_id").distinct(), _rules(spark).select("criterion").distinct()
    return files.crossJoin(F.broadcast(criteria)).join(_conformance(spark, d), ["file_id", "criterion"], "left").fillna("Supports", ["conformance"])


@query("ag49_issue_clusters", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY issue_id) AS r FROM issues) SELECT code, count(DISTINCT file_id) AS files, count(*) AS instances, max(severity) FILTER (r = 1) AS severity, max(message) FILTER (r = 1) AS message, string_agg(message, '|' ORDER BY r) FILTER (r <= 3) AS examples FROM n GROUP BY 1", "issues")
def _(spark, d):
    return iss.clusters(view(spark, d, "issues"), "code", "file_id", "issue_id")


@query("ag50_worst_conformance", f"WITH {_CONF_CTE} SELECT criterion, arg_min(conformance, CASE conformance WHEN 'Does Not Support' THEN 0 WHEN 'Partially Supports' THEN 1 ELSE 2 END) AS worst, count(*) AS n FROM conf GROUP BY 1", "issues")
def _(spark, d):
    return iss.worst_of(_conformance(spark, d), "criterion", "conformance", {"Does Not Support": 0, "Partially Supports": 1, "Supports": 2})


@query("ag51_triage_counts", "SELECT file_id, count(*) FILTER (page IS NULL) AS unplaced, count(*) FILTER (page < 3) AS contents, count(*) FILTER (page >= 3 AND severity = 'minor') AS artifact, count(*) FILTER (page >= 3 AND severity <> 'minor') AS manual FROM issues GROUP BY 1", "issues")
def _(spark, d):
    p, minor = F.col("page"), F.col("severity") == "minor"
    return view(spark, d, "issues").groupBy("file_id").agg(F.count_if(p.isNull()).alias("unplaced"), F.count_if(p < 3).alias("contents"), F.count_if((p >= 3) & minor).alias("artifact"), F.count_if((p >= 3) & ~minor).alias("manual"))


@query("re9_triage_precedence", "SELECT issue_id, CASE WHEN severity = 'critical' THEN 'existing' WHEN page < 3 THEN 'toc' WHEN page >= 27 THEN 'artifact' WHEN location = 'loc1' THEN 'list' ELSE 'manual' END AS disposition FROM issues", "issues")
def _(spark, d):
    return codes.triage(view(spark, d, "issues"), existing=F.col("severity") == "critical", toc=F.col("page") < 3, artifact=F.col("page") >= 27, in_list=F.col("location") == "loc1").select("issue_id", "disposition")


@query("jn11_audit_diff")
def _(spark, d):
    i = view(spark, d, "issues").withColumn("code", F.concat(F.lit("C"), (F.col("issue_id") % 5).cast("string")))
    return iss.compare_audits(i.where("stage = 0"), i.where("stage = 1"), ["file_id"], "issue_id").groupBy("file_id", "status").agg(F.count("*").alias("n"))


@query("ag52_reaudit_metrics")
def _(spark, d):
    i = view(spark, d, "issues").withColumn("code", F.concat(F.lit("C"), (F.col("issue_id") % 5).cast("string")))
    return iss.reaudit_metrics(iss.compare_audits(i.where("stage = 0"), i.where("stage = 1"), ["file_id"], "issue_id"), ["file_id"])


@query("jn12_same_location", "SELECT a.issue_id, b.issue_id AS other FROM issues a JOIN issues b ON a.file_id = b.file_id AND a.code = b.code AND a.issue_id < b.issue_id WHERE CASE WHEN a.page IS NOT NULL AND b.page IS NOT NULL THEN a.page = b.page ELSE coalesce(a.location = b.location, false) END", "issues")
def _(spark, d):
    i = view(spark, d, "issues").select("file_id", "code", "issue_id", "page", "location")
    b = i.select("file_id", "code", F.col("issue_id").alias("other"), F.col("page").alias("p2"), F.col("location").alias("l2"))
    return i.join(b, ["file_id", "code"]).where(F.col("issue_id") < F.col("other")).where(iss.same_location(F.col("page"), F.col("p2"), F.col("location"), F.col("l2"))).select("issue_id", "other")


@query("jn9_dismissals", "WITH k AS (SELECT issue_id, sha256('[\"' || code || '\",\"' || location || '\",\"' || message || '\"]') AS key FROM issues), x AS (SELECT DISTINCT key FROM k WHERE issue_id % 50 = 0) SELECT k.issue_id, k.key, x.key IS NOT NULL AS dismissed FROM k LEFT JOIN x USING (key)", "issues")
def _(spark, d):
    k = view(spark, d, "issues").select("issue_id", iss.instance_key(F.col("code"), F.col("location"), F.col("message")).alias("key"))
    gone = k.where("issue_id % 50 = 0").select("key").distinct().withColumn("_x", F.lit(True))
    return k.join(gone, "key", "left").select("issue_id", "key", F.col("_x").isNotNull().alias("dismissed"))


@query("sf29_instance_key", "SELECT issue_id, sha256('[\"' || code || '\",\"' || message || '\"]') AS key FROM issues", "issues")
def _(spark, d):
    return view(spark, d, "issues").select("issue_id", iss.instance_key(F.col("code"), F.col("message")).alias("key"))


@query("jn10_discovered_fixes", "SELECT issue_id FROM issues WHERE stage = 0 AND code || ':' || location NOT IN (SELECT code || ':' || location FROM issues WHERE stage = 1)", "issues")
def _(spark, d):
    i = view(spark, d, "issues").withColumn("sig", F.concat_ws(":", "code", "location"))
    return i.where("stage = 0").join(i.where("stage = 1").select("sig").distinct(), "sig", "left_anti").select("issue_id")


@query("jn19_rule_criteria", f"WITH {_RULES} SELECT criterion, count(*) AS n_issues, count(DISTINCT code) AS n_codes FROM issues JOIN rules USING (code) GROUP BY 1", "issues")
def _(spark, d):
    return iss.per_criterion(view(spark, d, "issues"), _rules(spark))


@query("ag54_criteria_summary", f"WITH {_RULES} SELECT criterion, severity, count(*) AS n FROM issues JOIN rules USING (code) GROUP BY 1, 2", "issues")
def _(spark, d):
    return view(spark, d, "issues").join(F.broadcast(_rules(spark)), "code").groupBy("criterion", "severity").agg(F.count("*").alias("n"))


@query("ag53_change_summary", "SELECT event_type AS field, count(*) AS total, count(*) FILTER (issue_id % 4 = 0) AS applied, count(*) FILTER (issue_id % 4 IN (1, 2)) AS rejected, count(*) FILTER (issue_id % 4 = 3) AS pending FROM issues GROUP BY 1", "issues")
def _(spark, d):
    status = F.when(F.col("issue_id") % 4 == 0, "APPLIED").when(F.col("issue_id") % 4 == 1, "REVERTED").when(F.col("issue_id") % 4 == 2, "REJECTED").otherwise("PENDING")
    return codes.change_summary(view(spark, d, "issues").withColumn("status", status), F.col("event_type").alias("field"))


@query("ag55_confidence_levels", "SELECT source_no, count(*) FILTER (issue_id % 4 = 0) AS manual, count(*) FILTER (issue_id % 4 = 1) AS high, count(*) FILTER (issue_id % 4 = 2) AS medium, count(*) FILTER (issue_id % 4 = 3) AS low FROM issues GROUP BY 1", "issues")
def _(spark, d):
    k = F.col("issue_id") % 4
    return view(spark, d, "issues").groupBy("source_no").agg(*[F.count_if(k == i).alias(n) for i, n in enumerate(("manual", "high", "medium", "low"))])


@query("ag10_similarity_breakdown", f"SELECT source_no, severity, count(*) AS n, {js('avg(value)', 3)} AS mean FROM issues GROUP BY 1, 2", "issues")
def _(spark, d):
    return view(spark, d, "issues").groupBy("source_no", "severity").agg(F.count("*").alias("n"), half_up(F.avg("value"), 3).alias("mean"))


@query("ag65_response_stats", f"SELECT count(*) AS n, count(page) AS answered, {js('count(page) * 100.0 / count(*)', 1)} AS response_pct FROM issues", "issues")
def _(spark, d):
    return view(spark, d, "issues").agg(F.count("*").alias("n"), F.count("page").alias("answered"), pct(F.count("page"), F.count("*"), 1).alias("response_pct"))


@query("set6_issue_dedup", "SELECT min(issue_id) AS issue_id FROM issues GROUP BY file_id, code, severity, page, location, message, source_no", "issues")
def _(spark, d):
    return iss.first_of_key(view(spark, d, "issues"), ["file_id", "code", "severity", "page", "location", "message", "source_no"], ["issue_id"]).select("issue_id")


@query("set12_collapsed_contents", "SELECT file_id, page, 0 AS suppressed, code FROM issues WHERE NOT coalesce(page < 3, false) UNION ALL SELECT file_id, page, count(*), 'TOC' FROM issues WHERE page < 3 GROUP BY 1, 2", "issues")
def _(spark, d):
    return iss.collapse_contents(view(spark, d, "issues"), F.coalesce(F.col("page") < 3, F.lit(False)), ["file_id"], "page")


@query("set7_three_tier_dedup")
def _(spark, d):
    i = view(spark, d, "issues").select("file_id", "issue_id", F.col("code").alias("rule"), (F.col("issue_id") % 90).alias("start"), (F.col("issue_id") % 90 + 7).alias("end"), F.concat(F.lit("matched "), "message").alias("match"))
    return iss.three_tier_dedup(i, ["file_id"], ["issue_id"])


_TALLY = "SELECT file_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (source_no = {i}) AS source_{i}" for i in range(3)) + ", " + ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in iss.SEVERITY_POINTS) + ", true AS consistent FROM issues GROUP BY 1"


@query("lx28_tally", _TALLY, "issues")
def _(spark, d):
    return iss.tally(view(spark, d, "issues"), ["file_id"])


@query("lx29_tally_change", "WITH a AS (SELECT file_id, count(*) AS before FROM issues WHERE stage = 0 GROUP BY 1), b AS (SELECT file_id, count(*) AS after FROM issues WHERE stage = 1 GROUP BY 1) SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(before, 0) AS before, coalesce(after, 0) AS after, coalesce(before, 0) - coalesce(after, 0) AS lost FROM a FULL JOIN b ON a.file_id = b.file_id", "issues")
def _(spark, d):
    i = view(spark, d, "issues")
    return iss.tally_change(iss.tally(i.where("stage = 0"), ["file_id"]), iss.tally(i.where("stage = 1"), ["file_id"]), ["file_id"])


@query("lx22_resolutions", "WITH b AS (SELECT DISTINCT file_id, code FROM issues WHERE stage = 0), a AS (SELECT DISTINCT file_id, code FROM issues WHERE stage = 1 AND severity = 'critical'), m AS (SELECT DISTINCT file_id, code FROM issues WHERE page = 5) SELECT b.file_id, b.code, CASE WHEN a.code IS NULL THEN 'fixed' WHEN m.code IS NOT NULL THEN 'failed' ELSE 'pending' END AS status FROM b LEFT JOIN a ON a.file_id = b.file_id AND a.code = b.code LEFT JOIN m ON m.file_id = b.file_id AND m.code = b.code", "issues")
def _(spark, d):
    i = view(spark, d, "issues")
    return iss.resolutions(i.where("stage = 0"), i.where("stage = 1 AND severity = 'critical'"), i.where("page = 5"), ["file_id", "code"])


@query("lx23_file_diff", "WITH a AS (SELECT file_id, count(*) AS n FROM issues WHERE stage = 0 AND file_id % 7 <> 0 GROUP BY 1), b AS (SELECT file_id, count(*) AS n FROM issues WHERE stage = 1 AND file_id % 5 <> 0 GROUP BY 1) SELECT CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS change, count(*) AS files FROM a FULL JOIN b ON a.file_id = b.file_id WHERE a.n IS DISTINCT FROM b.n GROUP BY 1", "issues")
def _(spark, d):
    i = view(spark, d, "issues")
    a, b = (i.where(c).groupBy("file_id").agg(F.count("*").alias("n")) for c in ("stage = 0 AND file_id % 7 <> 0", "stage = 1 AND file_id % 5 <> 0"))
    return rel.change_log(a, b, "file_id", ["n"]).groupBy("change").agg(F.count("*").alias("files"))


@query("lx24_audit_summary", "SELECT severity, count(*) FILTER (code IN ('R1', 'R2', 'R3')) AS auto, count(*) FILTER (code NOT IN ('R1', 'R2', 'R3')) AS manual FROM issues GROUP BY 1", "issues")
def _(spark, d):
    auto = F.col("code").isin("R1", "R2", "R3")
    return view(spark, d, "issues").groupBy("severity").agg(F.count_if(auto).alias("auto"), F.count_if(~auto).alias("manual"))


@query("lx25_resolved_tasks", "SELECT DISTINCT file_id, code FROM issues WHERE stage = 0 EXCEPT SELECT file_id, code FROM issues WHERE stage = 1", "issues")
def _(spark, d):
    i = view(spark, d, "issues")
    return i.where("stage = 0").select("file_id", "code").distinct().join(i.where("stage = 1"), ["file_id", "code"], "left_anti")


@query("lx26_similar_groups", "SELECT CASE WHEN page IS NULL THEN code ELSE 'fix' || page END AS group_key, count(*) AS n, count(*) >= 3 AS batchable FROM issues GROUP BY 1", "issues")
def _(spark, d):
    return iss.similar_groups(view(spark, d, "issues").withColumn("fix", F.concat(F.lit("fix"), F.col("page").cast("string"))))


_DONE = "count(*) FILTER (page < 10) * 100.0 / count(*)"


@query("lx27_plan_progress", f"SELECT file_id, count(*) AS total, {js(_DONE)} AS completed_pct, count(*) FILTER (NOT coalesce(page < 10, false) AND severity = 'critical') AS critical_left, count(*) FILTER (NOT coalesce(page < 10, false) AND code NOT IN ('R1', 'R2')) * 5 AS minutes_left FROM issues GROUP BY 1", "issues")
def _(spark, d):
    i = view(spark, d, "issues")
    return iss.plan_progress(i.withColumn("status", F.when(F.col("page") < 10, "completed").otherwise("pending")).withColumn("auto", F.col("code").isin("R1", "R2")), ["file_id"])


@query("lx30_missing_between_stages", "SELECT DISTINCT file_id, message FROM issues WHERE source_no = 0 EXCEPT SELECT file_id, message FROM issues WHERE source_no = 1", "issues")
def _(spark, d):
    i = view(spark, d, "issues")
    return i.where("source_no = 0").select("file_id", "message").distinct().join(i.where("source_no = 1").select("file_id", "message").distinct(), ["file_id", "message"], "left_anti")


@query("lx31_criterion_status", f"WITH {_RULES}, j AS (SELECT criterion, severity, issue_id FROM issues JOIN rules USING (code)) SELECT criterion, count(*) AS n, count(*) FILTER (issue_id % 6 = 0) AS fixed, CASE WHEN count(*) FILTER (issue_id % 6 <> 0) = 0 THEN 'Supports' WHEN count(*) FILTER (issue_id % 6 <> 0 AND severity = 'critical') > 0 THEN 'Does Not Support' ELSE 'Partially Supports' END AS status FROM j GROUP BY 1", "issues")
def _(spark, d):
    return codes.criterion_status(view(spark, d, "issues"), _rules(spark), F.col("issue_id") % 6 == 0)


@query("lx33_report_statistics", f"WITH {_CONF_CTE} SELECT conformance, count(*) AS n, count(DISTINCT file_id) AS files FROM conf GROUP BY 1", "issues")
def _(spark, d):
    return _conformance(spark, d).groupBy("conformance").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))


_COND = "c AS (SELECT i AS condition, i // 5 AS checkpoint, i % 7 <> 0 AS applicable, i % 4 = 0 AS human, i % 3 <> 1 AS tested FROM generate_series(0, 39) t(i)), f AS (SELECT CAST(substr(code, 2) AS BIGINT) AS condition, count(*) AS n_failures FROM issues WHERE severity = 'critical' AND event_id_mod = 0 GROUP BY 1), s AS (SELECT c.*, coalesce(n_failures, 0) AS n_failures, CASE WHEN NOT applicable THEN '--' WHEN coalesce(n_failures, 0) > 0 THEN 'FAIL' WHEN human THEN 'H' WHEN tested THEN 'PASS' ELSE 'UNTESTED' END AS status FROM c LEFT JOIN f USING (condition))".replace("event_id_mod = 0", "issue_id % 3 = 0")


def _conditions(spark, d):
    c = spark.range(40).select(F.col("id").alias("condition"), F.floor(F.col("id") / 5).alias("checkpoint"), (F.col("id") % 7 != 0).alias("applicable"), (F.col("id") % 4 == 0).alias("human"), (F.col("id") % 3 != 1).alias("tested"))
    f = view(spark, d, "issues").where("severity = 'critical' AND issue_id % 3 = 0").select(F.expr("CAST(substring(code, 2) AS BIGINT)").alias("condition"))
    return iss.condition_status(c, f)


@query("lx34_condition_status", f"WITH {_COND} SELECT condition, checkpoint, applicable, human, tested, n_failures, status FROM s", "issues")
def _(spark, d):
    return _conditions(spark, d)


@query("lx35_checkpoint_rollup", f"WITH {_COND} SELECT checkpoint, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'UNTESTED') THEN 'UNTESTED' WHEN bool_and(status IN ('H', '--')) THEN 'H' ELSE 'PASS' END AS status FROM s GROUP BY 1", "issues")
def _(spark, d):
    return iss.checkpoint_rollup(_conditions(spark, d))


_MAPPED = f"{_CONF_CTE}, worst AS (SELECT criterion, arg_min(conformance, CASE conformance WHEN 'Does Not Support' THEN 0 WHEN 'Partially Supports' THEN 1 ELSE 2 END) AS conformance FROM conf GROUP BY 1), m AS (SELECT 'E' || substr(criterion, 1, 3) AS clause, conformance FROM worst), k AS (SELECT clause, count(*) AS n, CASE WHEN bool_and(conformance = 'Supports') THEN 'Supports' WHEN bool_and(conformance = 'Does Not Support') THEN 'Does Not Support' ELSE 'Partially Supports' END AS status FROM m GROUP BY 1)"


def _mapped(spark, d):
    worst = iss.worst_of(_conformance(spark, d), "criterion", "conformance", {"Does Not Support": 0, "Partially Supports": 1, "Supports": 2}).select("criterion", F.col("worst").alias("conformance"))
    mapping = _rules(spark).select("criterion").distinct().withColumn("clause", F.concat(F.lit("E"), F.left("criterion", F.lit(3))))
    return iss.standard_mapping(worst, mapping)


@query("lx36_standard_mapping", f"WITH {_MAPPED} SELECT * FROM k", "issues")
def _(spark, d):
    return _mapped(spark, d)


_MEAN = "avg(CASE status WHEN 'Supports' THEN 100.0 WHEN 'Partially Supports' THEN 50.0 ELSE 0.0 END)"


@query("lx37_overall_compliance", f"WITH {_MAPPED} SELECT {js(_MEAN)} AS overall, count(*) AS n FROM k", "issues")
def _(spark, d):
    return iss.overall_compliance(_mapped(spark, d))


@query("lx39_verification_queue", f"WITH {_RULES}, r AS (SELECT DISTINCT criterion, CAST(substr(criterion, 3, 1) AS INTEGER) AS cr FROM rules), i AS (SELECT criterion, min(CASE severity WHEN 'critical' THEN 0 WHEN 'serious' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END) AS sev FROM issues JOIN rules USING (code) GROUP BY 1) SELECT r.criterion, coalesce(sev, 99) AS severity_rank, cr AS confidence_rank FROM r LEFT JOIN i USING (criterion)", "issues")
def _(spark, d):
    results = _rules(spark).select("criterion").distinct().withColumn("confidence_rank", F.expr("CAST(substring(criterion, 3, 1) AS INT)"))
    return iss.verification_queue(results, view(spark, d, "issues").join(F.broadcast(_rules(spark)), "code"))


@query("lx40_can_finalise", "SELECT file_id, count(*) FILTER (severity IN ('critical', 'serious') AND page IS NULL) AS blockers, count(*) FILTER (severity IN ('critical', 'serious') AND page IS NULL) = 0 AS can_finalise FROM issues GROUP BY 1", "issues")
def _(spark, d):
    n = F.count_if(F.col("severity").isin("critical", "serious") & F.col("page").isNull())
    return view(spark, d, "issues").groupBy("file_id").agg(n.alias("blockers"), (n == 0).alias("can_finalise"))


@query("lx41_filtered_queue", "SELECT issue_id FROM issues WHERE severity IN ('critical', 'minor') AND source_no IN (0, 2)", "issues")
def _(spark, d):
    return codes.filter_in(view(spark, d, "issues"), severity=["critical", "minor"], source_no=[0, 2], location=None).select("issue_id")


@query("lx42_quantities", f"SELECT file_id, count(*) AS total, count(page) AS passed, count(*) - count(page) AS failed, {js('count(page) * 100.0 / count(*)', 1)} AS pass_rate FROM issues GROUP BY 1", "issues")
def _(spark, d):
    return codes.quantities(view(spark, d, "issues").groupBy("file_id").agg(F.count("*").alias("total"), F.count("page").alias("passed")))


@query("sf25_issue_category", "SELECT issue_id, CASE code WHEN 'R1' THEN 'images' WHEN 'R2' THEN 'tables' ELSE CASE WHEN starts_with(code, 'R1') THEN 'structure' WHEN starts_with(code, 'R3') THEN 'links' WHEN contains(message, '7') THEN 'text' ELSE 'other' END END AS category FROM issues", "issues")
def _(spark, d):
    return view(spark, d, "issues").select("issue_id", codes.category(F.col("code"), F.col("message"), {"R1": "images", "R2": "tables"}, {"R1": "structure", "R3": "links"}, {"7": "text"}).alias("category"))


@query("sf26_rule_maps", "SELECT issue_id, CASE code WHEN 'R4' THEN 'alt-text' WHEN 'R5' THEN 'heading' ELSE 'other' END AS change_type FROM issues", "issues")
def _(spark, d):
    from tessella.functions.labels import lookup

    return view(spark, d, "issues").select("issue_id", F.coalesce(lookup(F.col("code"), {"R4": "alt-text", "R5": "heading", "R6": "other"}), F.lit("other")).alias("change_type"))


@query("sf27_criterion_principle", f"WITH {_RULES} SELECT issue_id, criterion, CASE substr(criterion, 1, 1) WHEN '1' THEN 'Perceivable' WHEN '2' THEN 'Operable' END AS principle FROM issues JOIN rules USING (code)", "issues")
def _(spark, d):
    found = view(spark, d, "issues").join(F.broadcast(_rules(spark)), "code")
    return found.select("issue_id", "criterion", codes.principle(F.col("criterion")).alias("principle"))


@query("sf32_remarks", "SELECT issue_id, CASE WHEN severity = 'minor' THEN 'ok' WHEN length(message) < 10 THEN 'too short' WHEN NOT contains(message, '1') THEN 'no detail' ELSE 'ok' END AS remark_check FROM issues", "issues")
def _(spark, d):
    return view(spark, d, "issues").select("issue_id", codes.remark_check(F.col("severity") != "minor", F.col("message"), 10, ["1"]).alias("remark_check"))


@query("mf6_confidence", "SELECT issue_id, CAST(CASE severity WHEN 'critical' THEN 0.9 WHEN 'serious' THEN 0.75 ELSE 0.6 END + CASE WHEN page IS NULL THEN -0.1 ELSE 0.0 END AS DOUBLE) AS confidence FROM issues", "issues")
def _(spark, d):
    s = F.col("severity")
    return view(spark, d, "issues").select("issue_id", (F.when(s == "critical", 0.9).when(s == "serious", 0.75).otherwise(0.6) + F.when(F.col("page").isNull(), -0.1).otherwise(0.0)).alias("confidence"))


@query("mf7_confidence_label", "SELECT issue_id, CASE WHEN value >= 20 THEN 'High' WHEN value >= 8 THEN 'Medium' ELSE 'Low' END AS label FROM issues", "issues")
def _(spark, d):
    return view(spark, d, "issues").select("issue_id", codes.confidence_label(F.col("value"), 20, 8).alias("label"))


@query("re10_criterion_tiers", f"WITH {_RULES} SELECT criterion, CASE WHEN criterion LIKE '1.1.%' THEN 'manual' WHEN criterion LIKE '1.%' THEN 'high' ELSE 'medium' END AS tier, count(*) AS issues FROM issues JOIN rules USING (code) GROUP BY ALL", "issues")
def _(spark, d):
    c = F.col("criterion")
    found = view(spark, d, "issues").join(F.broadcast(_rules(spark)), "code").groupBy("criterion").agg(F.count("*").alias("issues"))
    return found.select("criterion", "issues", F.when(c.startswith("1.1."), "manual").when(c.startswith("1."), "high").otherwise("medium").alias("tier"))


@query("re11_human_override", f"WITH {_CONF_CTE}, v AS (SELECT DISTINCT file_id, 'Supports' AS verified FROM issues WHERE file_id % 9 = 0) SELECT conf.file_id, criterion, coalesce(verified, conformance) AS conformance FROM conf LEFT JOIN v USING (file_id)", "issues")
def _(spark, d):
    v = view(spark, d, "issues").where("file_id % 9 = 0").select("file_id").distinct().withColumn("verified", F.lit("Supports"))
    return _conformance(spark, d).join(v, "file_id", "left").select("file_id", "criterion", F.coalesce("verified", "conformance").alias("conformance"))


@query("jf2_json_text", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("jf3_fallback_id", "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.job'), ''), CAST(user_id AS VARCHAR)) AS job FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.nullif(F.get_json_object("props", "$.job"), F.lit("")), F.col("user_id").cast("string")).alias("job"))


@query("jf1_first_array", "SELECT event_id, json_extract_string(props, '$.k') AS first_code FROM events")
def _(spark, d):
    doc = F.concat(F.lit('{"issues":[{"code":"'), F.get_json_object("props", "$.k"), F.lit('"}]}'))
    return table(spark, d, "events").select("event_id", codes.first_issue_array(doc)[0]["code"].alias("first_code"))


@query("src11_nested_report", "SELECT event_id, 'a' || j AS assertion, json_extract_string(props, '$.k') AS code FROM events, (SELECT unnest([0, 1]) AS j)")
def _(spark, d):
    k = F.get_json_object("props", "$.k")
    doc = F.format_string('{"assertions":[{"assertions":[{"id":"a0","code":"%s"},{"id":"a1","code":"%s"}]}]}', k, k)
    return codes.flatten_report(table(spark, d, "events").select("event_id", doc.alias("report")), "event_id", "report")


@query("mpf1_map_sums", "SELECT file_id, severity, sum(value) IS NOT NULL AS any, count(*) AS n FROM issues GROUP BY 1, 2", "issues")
def _(spark, d):
    n = view(spark, d, "issues").groupBy("file_id", "severity").agg(F.count("*").alias("n"))
    maps = n.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("m"))
    return maps.select("file_id", F.explode("m").alias("severity", "n")).select("file_id", "severity", F.lit(True).alias("any"), "n")


@query("mpf2_fixed_keys", "SELECT f.file_id, s.severity, count(i.issue_id) AS n FROM (SELECT DISTINCT file_id FROM issues) f CROSS JOIN (SELECT unnest(['critical', 'serious', 'unknown']) AS severity) s LEFT JOIN issues i ON i.file_id = f.file_id AND i.severity = s.severity GROUP BY 1, 2", "issues")
def _(spark, d):
    n = view(spark, d, "issues").groupBy("file_id", "severity").agg(F.count("*").alias("n"))
    m = n.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("m"))
    keys = F.array(*[F.lit(k) for k in ("critical", "serious", "unknown")])
    return m.select("file_id", F.explode(F.transform(keys, lambda k: F.struct(k.alias("severity"), F.coalesce(F.try_element_at("m", k), F.lit(0)).alias("n")))).alias("x")).select("file_id", "x.*")


@query("df1_days", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day"))


@query("df2_ms_difference", "SELECT event_id, epoch_us(ts) // 1000 - epoch_ms(TIMESTAMP '2024-01-01') AS ms FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", (F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lit("2024-01-01").cast("timestamp"))).alias("ms"))


@query("df3_latest_instant", "SELECT session_id, greatest(ended_ms, started_ms) AS last_ms FROM sessions", "sessions")
def _(spark, d):
    return view(spark, d, "sessions").select("session_id", F.greatest("ended_ms", "started_ms").alias("last_ms"))


@query("df4_last_days", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY")
def _(spark, d):
    return table(spark, d, "events").where("ts >= timestamp_ntz'2024-01-30' - INTERVAL 7 DAYS").select("event_id")


@query("af2_array_tests", "SELECT p_partkey, list_contains(w, 'red') AS has_red, len(list_filter(w, lambda x: length(x) > 3)) AS n_long FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def _(spark, d):
    w = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.array_contains(w, "red").alias("has_red"), F.size(F.filter(w, lambda x: F.char_length(x) > 3)).alias("n_long"))


@query("af3_deep_equality", "SELECT a.p_partkey FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1 WHERE string_split(a.p_name, ' ') = string_split(b.p_name, ' ')")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    q = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("w").alias("v"))
    return p.join(q, "p_partkey").where(F.col("w").eqNullSafe(F.col("v"))).select("p_partkey")
