"""Matching, accuracy, agreement, timesheets and corpus reports over the zone, decision and session views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import geometry as geo
from tessella.functions import labels as lab
from tessella.functions.numbers import duration_text, half_up, nearest_rank, pct, upper_median
from tessella.operators import agreement as agr
from tessella.operators import auto_annotation as auto
from tessella.operators import export as exp
from tessella.operators import matching as mat
from tessella.operators import timesheets as tim
from tessella.plans.registry import js, query
from tessella.sources.tables import table, view

ORDER = ["o1", "o2", "o3", "o4"]
PAGE = ["run_id", "page_number"]
HUMAN = "NOT coalesce(verified_by = 'auto-annotation' OR starts_with(verified_by, 'ai:'), false)"
FINAL = "CASE decision WHEN 'CONFIRMED' THEN zone_type WHEN 'CORRECTED' THEN coalesce(operator_label, zone_type) END"
HUMAN_LABEL = f"CASE WHEN {HUMAN} THEN {FINAL} END"


def _decisions(spark, d):
    final = lab.human_final_label(F.col("decision"), F.col("zone_type"), F.col("operator_label"), F.col("verified_by"))
    return view(spark, d, "decisions").withColumn("human_label", final)


def _iou_sql(a: str, b: str) -> str:
    w = f"greatest(0.0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
    h = f"greatest(0.0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    return f"(CASE WHEN {w} * {h} > 0 THEN {w} * {h} / ({a}.w * {a}.h + {b}.w * {b}.h - {w} * {h}) ELSE 0 END)"


@query("mf1_iou_candidates", f"SELECT a.run_id, count(*) AS pairs, count(*) FILTER (a.zone_type = b.zone_type) AS same, {js('avg(' + _iou_sql('a', 'b') + ')', 6)} AS mean_iou FROM zones a JOIN zones b USING (run_id, page_number) WHERE a.detector = 'A' AND b.detector = 'B' AND {_iou_sql('a', 'b')} >= 0.5 GROUP BY 1", "zones")
def _(spark, d):
    p = mat.count_pairs(view(spark, d, "zones"), PAGE)
    return p.groupBy("run_id").agg(F.sum("pairs").alias("pairs"), F.sum("same").alias("same"), half_up(F.sum("total") / F.sum("pairs"), 6).alias("mean_iou"))


@query("mf2_tolerant_box", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS width FROM events")
def _(spark, d):
    x, y, w, h = geo.tolerant_box(F.concat(F.lit('{"x":1,"y":2,"height":3,"width":'), F.get_json_object("props", "$.k"), F.lit("}")))
    return table(spark, d, "events").select("event_id", w.alias("width"))


@query("mf4_normalised_boxes", "SELECT o1, o2, o3, o4, least(1.0, greatest(0.0, (x + w / 2) / 100.0)) AS cx, least(1.0, greatest(0.0, w / 100.0)) AS cw FROM zones", "zones")
def _(spark, d):
    n = geo.normalised_centre(geo.box(), F.lit(100.0), F.lit(100.0))
    return view(spark, d, "zones").select(*ORDER, n["cx"].alias("cx"), n["cw"].alias("cw"))


@query("jn6_match_zones")
def _(spark, d):
    return mat.match_zones(view(spark, d, "zones"), PAGE, ORDER)


@query("ag11_match_summary")
def _(spark, d):
    return mat.summarise_matches(mat.match_zones(view(spark, d, "zones"), PAGE, ORDER), ["run_id"])


@query("ag12_corpus_green_rate")
def _(spark, d):
    s = mat.summarise_matches(mat.match_zones(view(spark, d, "zones"), PAGE, ORDER), ["run_id"])
    return s.where("total_zones > 0").agg(half_up(F.avg(F.col("green_count") / F.col("total_zones")), 4).alias("mean_green_rate"), F.count("*").alias("runs"))


def _scored(spark, d, *runs):
    """runs: those to score, all if none is given; matching never looks across runs."""
    z = view(spark, d, "zones")
    if runs:
        z = z.where(F.col("run_id").isin(*runs))
    truth, predicted = z.where("detector = 'A'"), z.where("detector = 'B'")
    matched = mat.match_precision(truth, predicted, ["run_id"], ORDER)
    return mat.average_precision(matched, truth, ["run_id"], ORDER)


@query("jn7_truth_matching")
def _(spark, d):
    z = view(spark, d, "zones")
    return mat.match_precision(z.where("detector = 'A'"), z.where("detector = 'B'"), ["run_id"], ORDER).groupBy("run_id", "zone_type").agg(F.sum("tp").alias("tp"), F.count("*").alias("n"))


@query("ag41_average_precision")
def _(spark, d):
    return _scored(spark, d).withColumn("ap", half_up("ap", 6))


@query("ag42_mean_average_precision")
def _(spark, d):
    return mat.mean_average_precision(_scored(spark, d), ["run_id"])


@query("wn7_cumulative_precision", f"WITH w AS (SELECT run_id, o1, o2, o3, o4, sum(CASE WHEN o2 = 1 THEN 1 ELSE 0 END) OVER q AS tp, count(*) OVER q AS n FROM zones WINDOW q AS (PARTITION BY run_id ORDER BY confidence DESC, o1, o2, o3, o4 ROWS UNBOUNDED PRECEDING)) SELECT run_id, o1, o2, o3, o4, tp, {js('tp / CAST(n AS DOUBLE)', 6)} AS precision FROM w", "zones")
def _(spark, d):
    by = Window.partitionBy("run_id").orderBy(F.desc("confidence"), *ORDER).rowsBetween(Window.unboundedPreceding, 0)
    z = view(spark, d, "zones").withColumn("tp", F.sum(F.when(F.col("o2") == 1, 1).otherwise(0)).over(by))
    return z.select("run_id", *ORDER, "tp", half_up(F.col("tp") / F.count("*").over(by), 6).alias("precision"))


@query("jn8_duplicate_figures")
def _(spark, d):
    return mat.duplicate_figures(view(spark, d, "zones").where("zone_type = 'figure'"), PAGE, ORDER)


@query("mf11_merge_boxes")
def _(spark, d):
    return mat.merge_boxes(view(spark, d, "zones").where("zone_type = 'table'"), PAGE, 5.0)


@query("wn17_reading_order")
def _(spark, d):
    return mat.reading_order(view(spark, d, "zones"), PAGE, ORDER)


@query("wn18_widest_gap", "WITH g AS (SELECT run_id, page_number, x - max(x + w) OVER (PARTITION BY run_id, page_number ORDER BY x, x + w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM zones WHERE zone_type = 'formula') SELECT run_id, page_number, greatest(0, coalesce(max(gap), 0)) AS gap FROM g GROUP BY 1, 2", "zones")
def _(spark, d):
    return mat.widest_gap(view(spark, d, "zones").where("zone_type = 'formula'").withColumn("right", F.col("x") + F.col("w")), PAGE, "x", "right")


@query("lx14_proximity_clusters", "WITH m AS (SELECT run_id, page_number, quantile_disc(-h, 0.5) * -1 AS usual FROM zones WHERE zone_type = 'table' GROUP BY 1, 2), r AS (SELECT z.*, usual, max(y + h) OVER (PARTITION BY run_id, page_number ORDER BY y, o1, o2, o3, o4 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM zones z JOIN m USING (run_id, page_number) WHERE zone_type = 'table'), c AS (SELECT *, sum(CASE WHEN reach IS NULL OR y - reach >= 0.5 * usual THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, page_number ORDER BY y, o1, o2, o3, o4 ROWS UNBOUNDED PRECEDING) AS cluster FROM r) SELECT run_id, page_number, cluster, min(x) AS x, min(y) AS y, max(x + w) AS \"right\", max(y + h) AS bottom, count(*) AS n FROM c GROUP BY 1, 2, 3", "zones")
def _(spark, d):
    return mat.cluster_by_proximity(view(spark, d, "zones").where("zone_type = 'table'"), PAGE, ORDER, 0.5)


@query("lx15_union_box", "SELECT run_id, page_number, zone_type, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM zones GROUP BY 1, 2, 3", "zones")
def _(spark, d):
    z = view(spark, d, "zones").groupBy(*PAGE, "zone_type")
    return z.agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))


@query("lx19_pixels_to_points", "SELECT o1, o2, o3, o4, x * 72.0 / 150 AS px, w * 72.0 / 150 AS pw FROM zones", "zones")
def _(spark, d):
    x, y, w, h = geo.pixels_to_points(geo.box(), F.lit(150))
    return view(spark, d, "zones").select(*ORDER, x.alias("px"), w.alias("pw"))


@query("ag13_grouped_accuracy", f"SELECT zone_type AS key, sum(CASE WHEN ai_label = hl THEN 1 ELSE 0 END) AS agree, count(*) AS total, avg(CASE WHEN ai_label = hl THEN 1 ELSE 0 END) AS rate FROM (SELECT *, {HUMAN_LABEL} AS hl FROM decisions) WHERE ai_label IS NOT NULL AND hl IS NOT NULL GROUP BY 1", "decisions")
def _(spark, d):
    rows = _decisions(spark, d).where("ai_label IS NOT NULL AND human_label IS NOT NULL")
    return agr.grouped_accuracy(rows, F.col("zone_type"), F.col("ai_label") == F.col("human_label"))


_KAPPA = f"""WITH r AS (SELECT run_id, CASE WHEN decision = 'REJECTED' THEN '__REJECTED__' ELSE {FINAL} END AS a, CASE WHEN ai_decision = 'REJECTED' THEN '__REJECTED__' ELSE ai_label END AS b FROM decisions WHERE decision IS NOT NULL AND ai_label IS NOT NULL),
 t AS (SELECT run_id, count(*) AS n, sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS same FROM r GROUP BY 1),
 l AS (SELECT run_id, a AS label, count(*) AS ka FROM r GROUP BY 1, 2), q AS (SELECT run_id, b AS label, count(*) AS kb FROM r GROUP BY 1, 2),
 c AS (SELECT run_id, sum(ka * kb) AS kk FROM l JOIN q USING (run_id, label) GROUP BY 1),
 k AS (SELECT run_id, n, same / CAST(n AS DOUBLE) AS po, coalesce(kk, 0) / (CAST(n AS DOUBLE) * n) AS pe FROM t LEFT JOIN c USING (run_id))"""


def _raters(spark, d):
    r = view(spark, d, "decisions").where("decision IS NOT NULL AND ai_label IS NOT NULL")
    final = lab.final_label(F.col("decision"), F.col("zone_type"), F.col("operator_label"))
    return r.select("run_id", lab.effective_label(F.col("decision"), final).alias("a"), lab.effective_label(F.col("ai_decision"), F.col("ai_label")).alias("b"))


@query("ag14_cohens_kappa", f"{_KAPPA} SELECT run_id, n, {js('po', 6)} AS po, {js('(po - pe) / (1 - pe)', 6)} AS kappa FROM k", "decisions")
def _(spark, d):
    return agr.cohens_kappa(_raters(spark, d), ["run_id"], "a", "b").withColumns({c: half_up(c, 6) for c in ("po", "kappa")})


@query("ag15_weighted_kappa", f"{_KAPPA} SELECT {js('sum((po - pe) / (1 - pe) * n) / sum(n)', 6)} AS value FROM k", "decisions")
def _(spark, d):
    return agr.weighted_mean(agr.cohens_kappa(_raters(spark, d), ["run_id"], "a", "b"), "kappa", "n").withColumn("value", half_up("value", 6))


_BIN = "CASE " + " ".join(f"WHEN ai_confidence >= {lo} AND ai_confidence < {hi} THEN '{n}'" for n, lo, hi in lab.CONFIDENCE_BINS) + " END"


@query("ag16_confidence_calibration", f"SELECT {_BIN} AS bucket, {js('avg(ai_confidence)', 3)} AS predicted, {js('avg(CASE WHEN ai_label = zone_type THEN 1 ELSE 0 END)', 3)} AS actual, count(*) AS count FROM decisions WHERE ai_label IS NOT NULL GROUP BY 1", "decisions")
def _(spark, d):
    return agr.confidence_calibration(view(spark, d, "decisions").where("ai_label IS NOT NULL"), F.col("ai_confidence"), F.col("ai_label") == F.col("zone_type"))


@query("ag17_override_rate", f"SELECT {_BIN} AS bucket, count(*) AS n, count(*) FILTER (decision IN ('CORRECTED', 'REJECTED')) AS overridden FROM decisions WHERE decision IS NOT NULL GROUP BY 1", "decisions")
def _(spark, d):
    r = view(spark, d, "decisions").where("decision IS NOT NULL")
    return r.groupBy(lab.confidence_bin(F.col("ai_confidence")).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("decision").isin("CORRECTED", "REJECTED")).alias("overridden"))


_CORRECTED = "count(*) FILTER (decision = 'CORRECTED') / CAST(count(*) AS DOUBLE)"


@query("ag18_merged_runs", f"SELECT zone_type, count(*) AS n, count(*) FILTER (decision = 'CORRECTED') AS corrected, {js(_CORRECTED, 4)} AS rate FROM decisions WHERE decision IS NOT NULL GROUP BY 1", "decisions")
def _(spark, d):
    r = view(spark, d, "decisions").where("decision IS NOT NULL").groupBy("zone_type").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "CORRECTED").alias("corrected"))
    return r.withColumn("rate", half_up(F.col("corrected") / F.col("n"), 4))


@query("ag19_common_mistakes", f"SELECT ai_label AS from_label, hl AS to_label, count(*) AS count FROM (SELECT *, {HUMAN_LABEL} AS hl FROM decisions) WHERE ai_label <> hl GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20", "decisions")
def _(spark, d):
    return agr.common_mistakes(_decisions(spark, d), F.col("ai_label"), F.col("human_label"))


@query("ag20_confusion_matrix", f"WITH p AS (SELECT ai_label AS a, {HUMAN_LABEL} AS b FROM decisions), q AS (SELECT a, b, count(*) AS n FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2), l AS (SELECT a AS label FROM q UNION SELECT b FROM q) SELECT x.label AS a_label, y.label AS b_label, coalesce(n, 0) AS n FROM l x CROSS JOIN l y LEFT JOIN q ON a = x.label AND b = y.label", "decisions")
def _(spark, d):
    return agr.confusion_matrix(_decisions(spark, d), F.col("ai_label"), F.col("human_label"))


@query("ag21_per_zone_type", f"""WITH t AS (SELECT zone_type, count(*) AS total_zones, count(*) FILTER (ai_decision = 'CONFIRMED') * 100.0 / count(*) AS ai_confirm_pct, count(*) FILTER (ai_decision = 'CORRECTED') * 100.0 / count(*) AS ai_correction_pct, count(*) FILTER (ai_decision = 'REJECTED') * 100.0 / count(*) AS ai_rejection_pct FROM decisions GROUP BY 1),
 c AS (SELECT zone_type, operator_label, row_number() OVER (PARTITION BY zone_type ORDER BY count(*) DESC, operator_label) AS r FROM decisions WHERE decision = 'CORRECTED' AND operator_label IS NOT NULL AND {HUMAN} GROUP BY 1, 2)
 SELECT t.*, operator_label AS top_corrected_to FROM t LEFT JOIN c ON t.zone_type = c.zone_type AND r = 1""", "decisions")
def _(spark, d):
    return agr.per_zone_type(view(spark, d, "decisions"))


@query("ag22_bucket_flow", f"SELECT bucket, count(*) AS total, count(*) FILTER (decision = 'CONFIRMED' AND {HUMAN}) AS human_confirmed, count(*) FILTER (decision = 'CORRECTED' AND {HUMAN}) AS human_corrected, count(*) FILTER (decision = 'REJECTED' AND {HUMAN}) AS human_rejected FROM decisions WHERE bucket IS NOT NULL GROUP BY 1", "decisions")
def _(spark, d):
    return agr.bucket_flow(view(spark, d, "decisions"))


@query("ag23_issues_by_category", "SELECT event_type AS category, count(DISTINCT file_id) AS titles, coalesce(sum(page), 0) AS pages, count(*) FILTER (severity = 'critical') AS blocking, count(*) AS n FROM issues GROUP BY 1", "issues")
def _(spark, d):
    i = view(spark, d, "issues").groupBy(F.col("event_type").alias("category"))
    return i.agg(F.countDistinct("file_id").alias("titles"), F.coalesce(F.sum("page"), F.lit(0)).alias("pages"), F.count_if(F.col("severity") == "critical").alias("blocking"), F.count("*").alias("n"))


@query("ag24_extractor_disagreement", f"SELECT hl AS final_label, count(*) AS total_zones, count(*) FILTER (a_label <> b_label) * 100.0 / count(*) AS disagreement_pct FROM (SELECT *, {HUMAN_LABEL} AS hl FROM decisions) WHERE hl IS NOT NULL AND a_label IS NOT NULL AND b_label IS NOT NULL GROUP BY 1", "decisions")
def _(spark, d):
    return agr.extractor_disagreement(_decisions(spark, d))


@query("ag24b_headline", f"SELECT count(*) AS total_zones, count(*) FILTER (ai_label = hl) / CAST(count(*) FILTER (ai_label IS NOT NULL AND hl IS NOT NULL) AS DOUBLE) AS ai_agreement_rate, count(*) FILTER ({HUMAN} AND decision = 'CORRECTED') / CAST(count(*) FILTER ({HUMAN} AND decision IS NOT NULL) AS DOUBLE) AS human_correction_rate, count(*) FILTER ({HUMAN} AND decision = 'REJECTED') / CAST(count(*) FILTER ({HUMAN} AND decision IS NOT NULL) AS DOUBLE) AS human_rejection_rate FROM (SELECT *, {HUMAN_LABEL} AS hl FROM decisions)", "decisions")
def _(spark, d):
    return agr.headline(_decisions(spark, d))


_WALL = "coalesce(ended_ms - started_ms, active_ms + idle_ms)"


@query("ag25_timesheet_totals", f"SELECT {js(f'sum({_WALL}) / 3600000.0', 6)} AS wall_clock_hours, {js('sum(active_ms) / 3600000.0', 6)} AS active_hours, {js('sum(idle_ms) / 3600000.0', 6)} AS idle_hours, sum(reviewed) AS zones_reviewed, {js('sum(reviewed) / (sum(active_ms) / 3600000.0)', 6)} AS zones_per_hour, {js('sum(active_ms) / 3600000.0 * 400', 4)} AS cost FROM sessions", "sessions")
def _(spark, d):
    return tim.totals(view(spark, d, "sessions")).withColumns({**{c: half_up(c, 6) for c in ("wall_clock_hours", "active_hours", "idle_hours", "zones_per_hour")}, "cost": half_up("cost", 4)})


@query("ag26_per_operator", f"SELECT operator_id, {js('sum(active_ms) / 3600000.0', 6)} AS active_hours, sum(reviewed) AS zones_reviewed, {js('sum(confirmed) * 100.0 / sum(confirmed + corrected + rejected)', 6)} AS confirmed_pct, count(DISTINCT run_id) AS runs FROM sessions GROUP BY 1", "sessions")
def _(spark, d):
    return tim.per_operator(view(spark, d, "sessions")).select("operator_id", half_up("active_hours", 6).alias("active_hours"), "zones_reviewed", half_up("confirmed_pct", 6).alias("confirmed_pct"), "runs")


@query("ag26b_per_title", f"WITH s AS (SELECT run_id, {js('sum(active_ms) / 3600000.0', 6)} AS active_hours, sum(reviewed) AS zones_reviewed, {js('sum(active_ms) / 3600000.0 * 400', 4)} AS cost FROM sessions GROUP BY 1), i AS (SELECT file_id % 16 AS run_id, count(*) AS n_issues FROM issues GROUP BY 1) SELECT run_id, active_hours, zones_reviewed, cost, n_name AS name, coalesce(n_issues, 0) AS n_issues FROM s LEFT JOIN nation ON run_id = n_nationkey LEFT JOIN i USING (run_id)", "sessions issues")
def _(spark, d):
    runs = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("run_id"), F.col("n_name").alias("name"))
    out = tim.per_title(view(spark, d, "sessions"), runs, view(spark, d, "issues").withColumn("run_id", F.col("file_id") % 16))
    return out.withColumns({"active_hours": half_up("active_hours", 6), "cost": half_up("cost", 4)})


@query("ag27_seconds_per_type", f"WITH k AS (SELECT run_id, zone_type, count(*) AS n FROM decisions WHERE decision IS NOT NULL AND coalesce(verified_by <> 'auto-annotation', true) GROUP BY 1, 2), r AS (SELECT run_id, sum(n) AS of_run FROM k GROUP BY 1), s AS (SELECT run_id, sum(active_ms) AS ms FROM sessions GROUP BY 1) SELECT zone_type, sum(n) AS total_zones, {js('sum(ms * (n / CAST(of_run AS DOUBLE))) / sum(n) / 1000', 4)} AS avg_seconds_per_zone FROM k JOIN r USING (run_id) JOIN s USING (run_id) GROUP BY 1", "decisions sessions")
def _(spark, d):
    return tim.seconds_per_type(view(spark, d, "sessions"), view(spark, d, "decisions")).withColumn("avg_seconds_per_zone", half_up("avg_seconds_per_zone", 4))


@query("ag28_operator_null_rates", f"SELECT operator_id, sum(active_ms) AS active_ms, sum(reviewed) AS reviewed, {js('sum(corrected) / CAST(nullif(sum(reviewed), 0) AS DOUBLE)', 6)} AS correction_rate, max(active_ms) AS longest_ms FROM sessions GROUP BY 1", "sessions")
def _(spark, d):
    return tim.per_operator_rates(view(spark, d, "sessions")).select("operator_id", "active_ms", "reviewed", half_up("correction_rate", 6).alias("correction_rate"), "longest_ms")


@query("ag29_distribute", "WITH p AS (SELECT run_id, page_number, count(*) AS weight FROM zones GROUP BY 1, 2), e AS (SELECT *, 1000 * weight / CAST(sum(weight) OVER (PARTITION BY run_id) AS DOUBLE) AS exact FROM p), f AS (SELECT *, floor(exact) AS fl, row_number() OVER (PARTITION BY run_id ORDER BY exact - floor(exact) DESC, page_number) AS r FROM e), g AS (SELECT *, 1000 - sum(fl) OVER (PARTITION BY run_id) AS spare FROM f) SELECT run_id, page_number, weight, CAST(fl + CASE WHEN r <= spare THEN 1 ELSE 0 END AS BIGINT) AS share FROM g", "zones")
def _(spark, d):
    p = view(spark, d, "zones").groupBy(*PAGE).agg(F.count("*").alias("weight"))
    return tim.distribute(p, ["run_id"], F.lit(1000), "weight", ["page_number"])


@query("ag30_annotation_report", "WITH p AS (SELECT run_id, page_number, count(*) FILTER (decision = 'CORRECTED') AS c FROM decisions GROUP BY 1, 2) SELECT run_id, count(*) FILTER (c = 0) AS clean_pages, max(c) AS most, arg_max(page_number, (c, -page_number)) AS page FROM p GROUP BY 1", "decisions")
def _(spark, d):
    p = view(spark, d, "decisions").groupBy(*PAGE).agg(F.count_if(F.col("decision") == "CORRECTED").alias("c"))
    return p.groupBy("run_id").agg(F.count_if(F.col("c") == 0).alias("clean_pages"), F.max("c").alias("most"), F.max_by("page_number", F.struct("c", (-F.col("page_number")).alias("n"))).alias("page"))


@query("ag31_lineage", f"SELECT bucket, count(*) AS n, {js('avg(ai_confidence)', 4)} AS mean_confidence, {js('quantile_cont(ai_confidence, 0.5)', 6)} AS median_confidence, count(*) FILTER (ai_label = zone_type) AS agree FROM decisions WHERE ai_label IS NOT NULL AND bucket IS NOT NULL GROUP BY 1", "decisions")
def _(spark, d):
    r = view(spark, d, "decisions").where("ai_label IS NOT NULL AND bucket IS NOT NULL")
    return r.groupBy("bucket").agg(F.count("*").alias("n"), half_up(F.avg("ai_confidence"), 4).alias("mean_confidence"), half_up(F.median("ai_confidence"), 6).alias("median_confidence"), F.count_if(F.col("ai_label") == F.col("zone_type")).alias("agree"))


@query("ag31b_confidence_histogram", "SELECT floor(ai_confidence * 20.0 + 0.000001) / 20.0 AS bin, count(*) AS n FROM decisions GROUP BY 1", "decisions")
def _(spark, d):
    return view(spark, d, "decisions").groupBy((F.floor(F.col("ai_confidence") * 20.0 + 0.000001) / 20.0).alias("bin")).agg(F.count("*").alias("n"))


@query("ag32_correction_patterns", "SELECT zone_type, operator_label, count(*) AS n FROM decisions WHERE decision = 'CORRECTED' AND operator_label IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10", "decisions")
def _(spark, d):
    from tessella.operators.relational import top_groups

    return top_groups(view(spark, d, "decisions").where("decision = 'CORRECTED' AND operator_label IS NOT NULL"), ["zone_type", "operator_label"], 10)


@query("ag33_costs", f"SELECT run_id, {js('sum(reviewed) * 1500 / 1000000.0 * 3.0 * 83', 4)} AS model_cost, {js('sum(active_ms) / 3600000.0 * 400', 4)} AS people_cost FROM sessions GROUP BY 1", "sessions")
def _(spark, d):
    s = view(spark, d, "sessions").groupBy("run_id")
    return s.agg(half_up(F.sum("reviewed") * 1500 / 1000000.0 * 3.0 * 83, 4).alias("model_cost"), half_up(F.sum("active_ms") / 3600000.0 * 400, 4).alias("people_cost"))


@query("ag34_version_means", f"{_KAPPA} SELECT 'v' || (run_id % 3) AS version, count(*) AS runs, {js('avg(po)', 6)} AS rate, {js('avg((po - pe) / (1 - pe))', 6)} AS kappa FROM k GROUP BY 1", "decisions")
def _(spark, d):
    k = agr.cohens_kappa(_raters(spark, d), ["run_id"], "a", "b")
    return k.groupBy(F.concat(F.lit("v"), (F.col("run_id") % 3).cast("string")).alias("version")).agg(F.count("*").alias("runs"), half_up(F.avg("po"), 6).alias("rate"), half_up(F.avg("kappa"), 6).alias("kappa"))


_PER_ZONE = "avg(active_ms / CAST(reviewed AS DOUBLE)) FILTER (mode {} 'blind')"


@query("ag35_time_savings", f"SELECT {js(_PER_ZONE.format('='), 3)} AS blind_ms, {js(_PER_ZONE.format('<>'), 3)} AS assisted_ms FROM sessions WHERE reviewed > 0", "sessions")
def _(spark, d):
    from tessella.operators.workflow import throughput

    return throughput(view(spark, d, "sessions")).select(half_up("blind_ms", 3).alias("blind_ms"), half_up("assisted_ms", 3).alias("assisted_ms"))


@query("ag36_study_averages", f"SELECT mode, {js('avg(active_ms)', 2)} AS avg_ms, {js('sum(reviewed) / (sum(active_ms) / 3600000.0)', 1)} AS pages_per_hour FROM sessions GROUP BY 1", "sessions")
def _(spark, d):
    return view(spark, d, "sessions").groupBy("mode").agg(half_up(F.avg("active_ms"), 2).alias("avg_ms"), half_up(F.sum("reviewed") / (F.sum("active_ms") / 3600000.0), 1).alias("pages_per_hour"))


@query("ag40_phase_gate")
def _(spark, d):
    from tessella.operators.workflow import phase_gate

    domain = spark.createDataFrame([(c,) for c in lab.CANONICAL], "zone_type string")
    return phase_gate(_scored(spark, d).withColumn("ap", half_up("ap", 6)), domain)


@query("ag43_model_delta")
def _(spark, d):
    return exp.model_delta(_scored(spark, d, 1), _scored(spark, d, 2))


@query("ag62_spot_check", f"SELECT bucket, count(*) AS n, {js('count(*) FILTER (zone_type = ai_label) * 100.0 / count(*)', 2)} AS agree_pct FROM decisions WHERE ai_label IS NOT NULL AND bucket IS NOT NULL GROUP BY 1", "decisions")
def _(spark, d):
    r = view(spark, d, "decisions").where("ai_label IS NOT NULL AND bucket IS NOT NULL")
    return r.groupBy("bucket").agg(F.count("*").alias("n"), pct(F.count_if(F.col("zone_type") == F.col("ai_label")), F.count("*"), 2).alias("agree_pct"))


@query("ag63_page_types", "SELECT run_id, page_number, CASE WHEN n = 0 THEN 'blank' WHEN f * 2 >= n THEN 'figure' WHEN t * 2 >= n THEN 'contents' WHEN n < 3 THEN 'sparse' ELSE 'body' END AS page_type FROM (SELECT r.run_id, g.page_number, count(z.o1) AS n, count(*) FILTER (zone_type = 'figure') AS f, count(*) FILTER (zone_type = 'toci') AS t FROM (SELECT DISTINCT run_id FROM zones) r CROSS JOIN (SELECT unnest(generate_series(1, 100)) AS page_number) g LEFT JOIN zones z ON z.run_id = r.run_id AND z.page_number = g.page_number GROUP BY 1, 2)", "zones")
def _(spark, d):
    return auto.page_types(view(spark, d, "zones"), 100)


@query("ag64_heading_offset", "SELECT run_id, count(DISTINCT CASE WHEN zone_type = 'section-header' AND h >= 25 THEN page_number END) > 2 AS offset_likely FROM zones GROUP BY 1", "zones")
def _(spark, d):
    n = F.countDistinct(F.when((F.col("zone_type") == "section-header") & (F.col("h") >= 25), F.col("page_number")))
    return view(spark, d, "zones").groupBy("run_id").agg((n > 2).alias("offset_likely"))


@query("wn5_page_index", "SELECT o1, o2, o3, o4, row_number() OVER (PARTITION BY run_id, page_number ORDER BY y, x, o1, o2, o3, o4) AS idx FROM zones", "zones")
def _(spark, d):
    return view(spark, d, "zones").select(*ORDER, F.row_number().over(Window.partitionBy(*PAGE).orderBy("y", "x", *ORDER)).alias("idx"))


@query("wn8_sampled_stretches", "WITH p AS (SELECT run_id, page_number, count(*) AS n, count(*) FILTER (decision = 'CONFIRMED') AS c FROM decisions GROUP BY 1, 2), i AS (SELECT *, page_number - row_number() OVER (PARTITION BY run_id ORDER BY page_number) AS g FROM p WHERE n > 10 AND c <= 16) SELECT run_id, min(page_number) AS first_page, max(page_number) AS last_page, count(*) AS n_pages FROM i GROUP BY run_id, g HAVING count(*) >= 3", "decisions")
def _(spark, d):
    p = view(spark, d, "decisions").groupBy(*PAGE).agg(F.count("*").alias("n_zones"), F.count_if(F.col("decision") == "CONFIRMED").alias("n_confirmed"))
    return tim.sampled_stretches(p, ["run_id"], 3, 10, 16)


@query("wn9_list_containers", "WITH z AS (SELECT *, CASE WHEN zone_type IN ('list-item', 'toci') THEN zone_type END AS k FROM zones), f AS (SELECT *, CASE WHEN k IS NOT DISTINCT FROM lag(k) OVER w THEN 0 ELSE 1 END AS new FROM z WINDOW w AS (PARTITION BY run_id, page_number ORDER BY y, x, o1, o2, o3, o4)), i AS (SELECT *, sum(new) OVER (PARTITION BY run_id, page_number ORDER BY y, x, o1, o2, o3, o4 ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT run_id, page_number, k AS kind, count(*) AS items FROM i WHERE k IS NOT NULL GROUP BY run_id, page_number, island, k", "zones")
def _(spark, d):
    return auto.containers(view(spark, d, "zones"), PAGE, ["y", "x", *ORDER])


@query("wn12_heading_levels")
def _(spark, d):
    return auto.heading_levels(view(spark, d, "zones").where("zone_type = 'section-header'"), ["run_id"], ["page_number", "y", *ORDER])


@query("mf8_heading_by_height", f"WITH m AS (SELECT run_id, page_number, -quantile_disc(-h, 0.5) AS usual FROM zones WHERE zone_type = 'paragraph' GROUP BY 1, 2) SELECT o1, o2, o3, o4, CASE WHEN h / usual >= 2 THEN 1 WHEN h / usual >= 1.5 THEN 2 WHEN h / usual >= 1.2 THEN 3 ELSE 4 END AS level FROM zones JOIN m USING (run_id, page_number) WHERE zone_type = 'section-header'", "zones")
def _(spark, d):
    z = view(spark, d, "zones")
    usual = z.where("zone_type = 'paragraph'").groupBy(*PAGE).agg(upper_median("h").alias("usual"))
    r = F.col("h") / F.col("usual")
    return z.where("zone_type = 'section-header'").join(usual, PAGE).select(*ORDER, F.when(r >= 2, 1).when(r >= 1.5, 2).when(r >= 1.2, 3).otherwise(4).alias("level"))


@query("wn19_daily_trend", f"WITH g AS (SELECT strftime(unnest(generate_series(DATE '1996-01-01', DATE '1996-03-31', INTERVAL 1 DAY)), '%Y-%m-%d') AS day), s AS (SELECT strftime(started_at, '%Y-%m-%d') AS day, sum(reviewed) AS reviewed, {js('sum(active_ms) / 3600000.0', 6)} AS active_hours, count(DISTINCT operator_id) AS operators FROM sessions WHERE started_at >= TIMESTAMP '1996-01-01' AND started_at < TIMESTAMP '1996-04-01' GROUP BY 1) SELECT day, coalesce(reviewed, 0) AS reviewed, coalesce(active_hours, 0) AS active_hours, coalesce(operators, 0) AS operators FROM g LEFT JOIN s USING (day)", "sessions")
def _(spark, d):
    s = view(spark, d, "sessions").where("started_at >= timestamp_ntz'1996-01-01' AND started_at < timestamp_ntz'1996-04-01'")
    return tim.daily_trend(s, "1996-01-01", "1996-03-31").withColumn("active_hours", half_up("active_hours", 6))


_K = "avg(CAST(json_extract_string(props, '$.k') AS DOUBLE))"


@query("wn20_feedback_trend", f"WITH g AS (SELECT strftime(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY)), '%Y-%m-%d') AS day), s AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, {js(_K, 1)} AS mean FROM events GROUP BY 1) SELECT day, coalesce(n, 0) AS n, mean FROM g LEFT JOIN s USING (day)")
def _(spark, d):
    e = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), half_up(F.avg(F.get_json_object("props", "$.k").cast("double")), 1).alias("mean"))
    g = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-10").cast("date"))).alias("x")).select(F.date_format("x", "yyyy-MM-dd").alias("day"))
    return g.join(e, "day", "left").fillna(0, ["n"])


@query("mf9_page_split", "SELECT o1, o2, o3, o4, CASE WHEN m < 800 THEN 'train' WHEN m < 900 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, CAST('0x' || substr(md5('doc' || run_id || ':' || page_number), 1, 8) AS BIGINT) % 1000 AS m FROM zones)", "zones")
def _(spark, d):
    return view(spark, d, "zones").select(*ORDER, exp.page_split(F.concat(F.lit("doc"), F.col("run_id").cast("string")), F.col("page_number")).alias("split"))


@query("mf10_stratified_split", "WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_custkey, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r")
def _(spark, d):
    return exp.stratified_split(table(spark, d, "customer"), ["c_nationkey"], ["c_custkey"]).select("c_custkey", "split")


@query("ag61_split_counts", "SELECT split, zone_type, count(*) AS n FROM (SELECT zone_type, CASE WHEN m < 800 THEN 'train' WHEN m < 900 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, CAST('0x' || substr(md5('doc' || run_id || ':' || page_number), 1, 8) AS BIGINT) % 1000 AS m FROM zones)) GROUP BY 1, 2", "zones")
def _(spark, d):
    z = view(spark, d, "zones").withColumn("split", exp.page_split(F.concat(F.lit("doc"), F.col("run_id").cast("string")), F.col("page_number")))
    return z.groupBy("split", "zone_type").agg(F.count("*").alias("n"))


_M = "CAST('0x' || substr(md5(run_id || ':' || page_number), 1, 8) AS BIGINT) % 1000"
_SPLIT = f"CASE WHEN {_M} < 800 THEN 'train' WHEN {_M} < 900 THEN 'val' ELSE 'test' END"
_CLAMPED = "least(1.0, greatest(0.0, {}))"
_LINE = "printf('%d %.6f %.6f %.6f %.6f', list_position(['" + "', '".join(lab.CANONICAL) + "'], zone_type) - 1, " + ", ".join(_CLAMPED.format(c) for c in ("(x + w / 2) / 100.0", "(y + h / 2) / 100.0", "w / 100.0", "h / 100.0")) + ")"


@query("snk11_training_lines", f"SELECT run_id, page_number, {_SPLIT} AS split, {_LINE} AS line FROM zones WHERE detector = 'A'", "zones")
def _(spark, d):
    return exp.training_lines(view(spark, d, "zones").where("detector = 'A'"), 100.0, 100.0)


@query("re8_auto_annotation")
def _(spark, d):
    return auto.annotate(view(spark, d, "decisions").join(view(spark, d, "zones").select(*ORDER, "x", "y", "w", "h").distinct(), ORDER)).groupBy("run_id", "pattern", "decision_out").agg(F.count("*").alias("n"))


@query("mf5_percentiles", "SELECT run_id, quantile_disc(active_ms, 0.5) AS p50, quantile_disc(active_ms, 0.9) AS p90 FROM sessions GROUP BY 1", "sessions")
def _(spark, d):
    return view(spark, d, "sessions").groupBy("run_id").agg(nearest_rank("active_ms", 0.5).alias("p50"), nearest_rank("active_ms", 0.9).alias("p90"))


@query("sf33_durations", "SELECT session_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS text FROM (SELECT session_id, active_ms // 1000 AS s FROM sessions)", "sessions")
def _(spark, d):
    return view(spark, d, "sessions").select("session_id", duration_text(F.col("active_ms")).alias("text"))
