"""Filters, projections, joins, pages, sets: the query surface of a record store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.numbers import half_up
from tessella.operators import relational as rel
from tessella.plans.registry import js, query
from tessella.sources.tables import table, view


@query("src1_scan_filter_order_limit", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("src2_point_lookup", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def _(spark, d):
    return table(spark, d, "customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_mktsegment")


@query("src3_first_in_order", "SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1")
def _(spark, d):
    orders = table(spark, d, "orders")
    return rel.latest(orders, ["o_custkey"], [F.asc("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query("src4_aggregate_scan", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def _(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("tessella_orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM tessella_orders GROUP BY 1")


@query("src5_json_path_filter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') = '69'")
def _(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").where(k == "69").select("event_id", k.cast("long").alias("k"))


@query("src6_latest_row", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    return rel.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("fil1_optional_equality", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'")
def _(spark, d):
    return rel.where_given(table(spark, d, "lineitem"), l_returnflag="R", l_linestatus="O", l_linenumber=None).select("l_orderkey", "l_partkey", "l_suppkey")


@query("fil2_contains_any_case", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%widget%' OR lower(p_type) LIKE '%widget%'")
def _(spark, d):
    return rel.contains_any_case(table(spark, d, "part"), "WidGet", "p_name", "p_type").select("p_partkey", "p_name")


@query("fil3_inclusive_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-03-31'")
def _(spark, d):
    return rel.between(table(spark, d, "orders"), "o_orderdate", F.expr("timestamp_ntz'1997-01-01'"), F.expr("timestamp_ntz'1997-03-31'")).select("o_orderkey")


@query("fil4_stale", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-03'")
def _(spark, d):
    return table(spark, d, "events").where("ts < timestamp_ntz'2024-01-03'").select("event_id")


@query("fil5_in_not_in", "SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND user_id NOT IN (1, 2, 3)")
def _(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("view", "click") & ~F.col("user_id").isin(1, 2, 3)).select("event_id")


@query("fil6_not_null", "SELECT run_id, count(*) AS n FROM decisions WHERE decision IS NOT NULL AND ai_label IS NOT NULL GROUP BY 1", "decisions")
def _(spark, d):
    return view(spark, d, "decisions").where(F.col("decision").isNotNull() & F.col("ai_label").isNotNull()).groupBy("run_id").agg(F.count("*").alias("n"))


@query("fil7_json_path_through_relation", "SELECT e.event_id, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE json_extract_string(e.props, '$.k') = '7'")
def _(spark, d):
    e = table(spark, d, "events").where(F.get_json_object("props", "$.k") == "7")
    return e.join(table(spark, d, "customer"), e["user_id"] == F.col("c_custkey")).select("event_id", "c_name")


@query("fil8_kind_by_substring", "SELECT page_id, CASE WHEN lower(url) LIKE '%/fr/%' THEN 'fr' WHEN lower(url) LIKE '%/de/%' THEN 'de' ELSE 'other' END AS kind FROM pages")
def _(spark, d):
    u = F.lower("url")
    return table(spark, d, "pages").select("page_id", F.when(u.contains("/fr/"), "fr").when(u.contains("/de/"), "de").otherwise("other").alias("kind"))


@query("fil9_soft_delete", "SELECT issue_id FROM issues WHERE page IS NULL", "issues")
def _(spark, d):
    return view(spark, d, "issues").where(F.col("page").isNull()).select("issue_id")


@query("fil10_quality_of_matches", "SELECT o1, o2, o3, o4 FROM zones WHERE confidence >= 0.3 AND zone_type <> 'caption' AND w >= 40", "zones")
def _(spark, d):
    return view(spark, d, "zones").where("confidence >= 0.3 AND zone_type <> 'caption' AND w >= 40").select("o1", "o2", "o3", "o4")


@query("fil11_export_filter", "SELECT o1, o2, o3, o4 FROM decisions WHERE coalesce(decision, '') <> 'REJECTED' AND (decision IS NOT NULL OR ai_confidence >= 0.5)", "decisions")
def _(spark, d):
    keep = F.coalesce(F.col("decision"), F.lit("")) != "REJECTED"
    return view(spark, d, "decisions").where(keep & (F.col("decision").isNotNull() | (F.col("ai_confidence") >= 0.5))).select("o1", "o2", "o3", "o4")


@query("prj1_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment")


@query("prj2_cascading_json", "SELECT event_id, coalesce(json_extract_string(props, '$.name'), json_extract_string(props, '$.k'), 'none') AS name FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.name"), F.get_json_object("props", "$.k"), F.lit("none")).alias("name"))


@query("prj3_enum_labels", "SELECT event_type, CASE event_type WHEN 'view' THEN 'Viewed' WHEN 'click' THEN 'Clicked' ELSE event_type END AS label, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    label = F.when(F.col("event_type") == "view", "Viewed").when(F.col("event_type") == "click", "Clicked").otherwise(F.col("event_type"))
    return table(spark, d, "events").groupBy("event_type", label.alias("label")).agg(F.count("*").alias("n"))


_STATUS = "CASE WHEN bool_or(ai_decision = 'REJECTED' AND decision = 'REJECTED' AND o2 = 3) THEN 'override' WHEN count(decision) = 0 THEN 'new' WHEN count(decision) = count(*) THEN 'done' ELSE 'partial' END"


@query("prj4_status_with_override", f"SELECT run_id, page_number, {_STATUS} AS status FROM decisions GROUP BY 1, 2", "decisions")
def _(spark, d):
    over = F.bool_or((F.col("ai_decision") == "REJECTED") & (F.col("decision") == "REJECTED") & (F.col("o2") == 3))
    status = F.when(over, "override").when(F.count("decision") == 0, "new").when(F.count("decision") == F.count("*"), "done").otherwise("partial")
    return view(spark, d, "decisions").groupBy("run_id", "page_number").agg(status.alias("status"))


@query("prj5_progress", "SELECT run_id, CASE WHEN count(decision) = 0 THEN 'NOT_STARTED' WHEN count(decision) >= count(*) THEN 'COMPLETE' ELSE 'IN_PROGRESS' END AS progress FROM decisions GROUP BY 1", "decisions")
def _(spark, d):
    n = F.count("decision")
    return view(spark, d, "decisions").groupBy("run_id").agg(F.when(n == 0, "NOT_STARTED").when(n >= F.count("*"), "COMPLETE").otherwise("IN_PROGRESS").alias("progress"))


@query("prj6_decode_entities", "SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS html FROM pages")
def _(spark, d):
    from tessella.functions.text import decode_entities

    return table(spark, d, "pages").select("page_id", decode_entities(F.col("html")).alias("html"))


@query("prj7_field_discrepancy", "SELECT a.s_suppkey, CASE WHEN lower(a.s_name) = lower(b.c_name) OR contains(lower(a.s_name), lower(b.c_name)) OR contains(lower(b.c_name), lower(a.s_name)) THEN 'same' ELSE 'differs' END AS name_check FROM supplier a JOIN customer b ON a.s_suppkey = b.c_custkey")
def _(spark, d):
    a, b = F.lower("s_name"), F.lower("c_name")
    s = table(spark, d, "supplier").join(table(spark, d, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    return s.select("s_suppkey", F.when((a == b) | a.contains(b) | b.contains(a), "same").otherwise("differs").alias("name_check"))


@query("jn1_relation_include", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("jn2_nested_include", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, d):
    kids = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), kids.alias("orders"))


@query("jn3_latest_child", "SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) ON o_custkey = c_custkey AND r = 1")
def _(spark, d):
    last = rel.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return table(spark, d, "customer").join(last, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


@query("jn4_lookup", "SELECT c_custkey, coalesce(n_name, 'none') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    # No forced broadcast: the planner knows the small table's size.
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("none")).alias("nation"))


@query("jn5_group_kept_without_match", "SELECT n_name, count(s_suppkey) AS runs, coalesce(sum(s_nationkey), 0) AS keys FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    j = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_name").agg(F.count("s_suppkey").alias("runs"), F.coalesce(F.sum("s_nationkey"), F.lit(0)).alias("keys"))


@query("jn15_point_in_interval", "WITH t AS (SELECT doc_id, length(text) AS n FROM documents), c AS (SELECT doc_id, unnest(generate_series(0, n // 1000)) AS chunk FROM t), e AS (SELECT event_id, event_id % 1000 AS doc_id, (event_id * 37) % 3000 AS spot FROM events) SELECT e.event_id, coalesce(min(c.chunk) FILTER (spot >= chunk * 1000 AND spot < chunk * 1000 + 1000), 0) AS chunk FROM e JOIN c USING (doc_id) GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.char_length("text").alias("n"))
    c = t.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 1000).cast("int"))).alias("chunk"))
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 1000).alias("doc_id"), ((F.col("event_id") * 37) % 3000).alias("at"))
    inside = (F.col("at") >= F.col("chunk") * 1000) & (F.col("at") < F.col("chunk") * 1000 + 1000)
    return e.join(c, "doc_id").groupBy("event_id").agg(F.coalesce(F.min(F.when(inside, F.col("chunk"))), F.lit(0)).alias("chunk"))


@query("jn16_offset_in_chapter", "WITH ch AS (SELECT c_nationkey AS book, c_custkey AS chapter, c_custkey * 10 AS lo, coalesce(lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) * 10, 1000000000) AS hi FROM customer), q AS (SELECT o_orderkey, o_orderkey % 25 AS book, (o_orderkey * 7) % 15000 AS spot FROM orders) SELECT o_orderkey, chapter FROM q LEFT JOIN ch ON q.book = ch.book AND spot >= lo AND spot < hi")
def _(spark, d):
    # A chapter ends where the book's next one begins, and no place comes near the end of the last.
    ch = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("book"), F.col("c_custkey").alias("chapter"), (F.col("c_custkey") * 10).alias("lo"))
    q = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 25).alias("book"), ((F.col("o_orderkey") * 7) % 15000).alias("at"))
    return rel.last_before(q, ch, ["book"], "at", "lo", ["chapter"], 1000).select("o_orderkey", "chapter")


@query("jn17_inside_band", "SELECT run_id, page_number, count(*) FILTER (y < 10 OR y + h > 85) AS in_band, count(*) AS n FROM zones GROUP BY 1, 2", "zones")
def _(spark, d):
    band = (F.col("y") < 10) | (F.col("y") + F.col("h") > 85)
    return view(spark, d, "zones").groupBy("run_id", "page_number").agg(F.count_if(band).alias("in_band"), F.count("*").alias("n"))


@query("jn18_nearest_in_radius", "WITH l AS (SELECT run_id, page_number, o1, o2, o3, o4, x, y FROM zones WHERE zone_type = 'list-item'), i AS (SELECT run_id, page_number, o1 AS i1, o2 AS i2, o3 AS i3, o4 AS i4, x AS ix, y AS iy FROM zones WHERE zone_type = 'caption'), p AS (SELECT *, (x - ix) * (x - ix) + (y - iy) * (y - iy) AS d2 FROM i JOIN l USING (run_id, page_number)) SELECT i1, i2, i3, i4, min(d2) AS d2 FROM p WHERE d2 <= 10000 GROUP BY ALL", "zones")
def _(spark, d):
    z = view(spark, d, "zones")
    lists = z.where("zone_type = 'list-item'").select("run_id", "page_number", "x", "y")
    at = z.where("zone_type = 'caption'").select("run_id", "page_number", *[F.col(f"o{i}").alias(f"i{i}") for i in range(1, 5)], F.col("x").alias("ix"), F.col("y").alias("iy"))
    d2 = (F.col("x") - F.col("ix")) * (F.col("x") - F.col("ix")) + (F.col("y") - F.col("iy")) * (F.col("y") - F.col("iy"))
    return at.join(lists, ["run_id", "page_number"]).withColumn("d2", d2).where("d2 <= 10000").groupBy("i1", "i2", "i3", "i4").agg(F.min("d2").alias("d2"))


@query("jn20_contains_join", "SELECT p.p_partkey, min(n.n_nationkey) AS first_nation FROM part p JOIN nation n ON contains(p.p_brand, CAST(n.n_nationkey AS VARCHAR)) GROUP BY 1")
def _(spark, d):
    n = table(spark, d, "nation")
    return table(spark, d, "part").join(F.broadcast(n), F.col("p_brand").contains(F.col("n_nationkey").cast("string"))).groupBy("p_partkey").agg(F.min("n_nationkey").alias("first_nation"))


@query("jn21_dangling_links", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def _(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 7 <> 0")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("jn22_ordered_join", "SELECT n_nationkey, n_name, row_number() OVER (ORDER BY r_regionkey, n_nationkey) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    from pyspark.sql import Window

    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("n_nationkey", "n_name", F.row_number().over(Window.orderBy("r_regionkey", "n_nationkey")).alias("place"))


_OLD = "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 5 <> 0"
_NEW = "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 7 <> 0"


@query("jn23_change_log", f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (c_custkey) WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment")
def _(spark, d):
    c = table(spark, d, "customer")
    new = c.where("c_custkey % 7 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 11 == 0, "NEW").otherwise(F.col("c_mktsegment")))
    return rel.change_log(c.where("c_custkey % 5 <> 0"), new, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query("jn24_baseline_agreement", "SELECT count(*) AS n, count(*) FILTER (a.zone_type = a.ai_label) AS agree FROM decisions a WHERE ai_label IS NOT NULL", "decisions")
def _(spark, d):
    return view(spark, d, "decisions").where("ai_label IS NOT NULL").agg(F.count("*").alias("n"), F.count_if(F.col("zone_type") == F.col("ai_label")).alias("agree"))


@query("jn25_counts_beside_rows", "SELECT c_custkey, n_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "n_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("jn26_backfill", "SELECT i.issue_id, coalesce(i.page, f.page) AS page FROM issues i LEFT JOIN (SELECT c_custkey AS file_id, c_custkey % 9 AS page FROM customer) f USING (file_id)", "issues")
def _(spark, d):
    f = table(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), (F.col("c_custkey") % 9).alias("page"))
    return rel.backfill(view(spark, d, "issues"), f, "file_id", "page").select("issue_id", "page")


@query("jn27_insert_missing", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("jn28_unnest", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("jn29_exists", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("jn30_relation_count", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("ag1_count_by_key", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("ag2_three_keys", "SELECT source_no, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (page IS NULL) AS pageless FROM issues GROUP BY 1", "issues")
def _(spark, d):
    i = view(spark, d, "issues").groupBy("source_no", "severity", F.col("page").isNull().alias("none")).agg(F.count("*").alias("n"))
    return i.groupBy("source_no").agg(F.sum("n").alias("total"), *[F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0)).alias(s) for s in ("critical", "minor")], F.sum(F.when(F.col("none"), F.col("n")).otherwise(0)).alias("pageless"))


@query("ag3_mean_and_count", f"SELECT {js('avg(page)', 4)} AS avg_page, count(page) AS n FROM issues", "issues")
def _(spark, d):
    return view(spark, d, "issues").agg(half_up(F.avg("page"), 4).alias("avg_page"), F.count("page").alias("n"))


@query("ag4_sum", "SELECT coalesce(sum(p_size), 0) AS total FROM part WHERE p_type = 'ECONOMY'")
def _(spark, d):
    return table(spark, d, "part").where("p_type = 'ECONOMY'").agg(F.coalesce(F.sum("p_size"), F.lit(0)).alias("total"))


@query("ag5_max_and_sum", "SELECT run_id, max(page_number) AS last_page, sum(o2) AS total FROM zones GROUP BY 1", "zones")
def _(spark, d):
    return view(spark, d, "zones").groupBy("run_id").agg(F.max("page_number").alias("last_page"), F.sum("o2").alias("total"))


@query("ag6_count_distinct", "SELECT run_id, count(DISTINCT page_number) AS pages FROM zones GROUP BY 1", "zones")
def _(spark, d):
    return view(spark, d, "zones").groupBy("run_id").agg(F.countDistinct("page_number").alias("pages"))


@query("ag7_counts", "SELECT run_id, count(*) AS n, count(decision) AS decided FROM decisions GROUP BY 1", "decisions")
def _(spark, d):
    return view(spark, d, "decisions").groupBy("run_id").agg(F.count("*").alias("n"), F.count("decision").alias("decided"))


@query("ag8_top_groups", "SELECT code, severity, count(*) AS n FROM issues GROUP BY 1, 2 ORDER BY n DESC, code, severity LIMIT 10", "issues")
def _(spark, d):
    return rel.top_groups(view(spark, d, "issues"), ["code", "severity"], 10)


@query("ag9_fixed_domain", "SELECT r.rating, count(p.page) AS n FROM (SELECT unnest(generate_series(1, 60)) AS rating) r LEFT JOIN issues p ON p.page = r.rating GROUP BY 1", "issues")
def _(spark, d):
    return rel.dense_counts(view(spark, d, "issues").withColumn("rating", F.col("page")), spark.range(1, 61).toDF("rating"), "rating")


@query("ag57_ranking", "SELECT event_type, count(*) AS n, count(*) FILTER (page IS NULL) AS unresolved FROM issues GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5", "issues")
def _(spark, d):
    return view(spark, d, "issues").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("page").isNull()).alias("unresolved")).orderBy(F.desc("n"), "event_type").limit(5)


@query("ag58_mean_from_json", "SELECT " + js("avg(CAST(coalesce(json_extract_string(props, '$.score'), json_extract_string(props, '$.k')) AS DOUBLE))", 4) + " AS score FROM events WHERE event_type = 'view'")
def _(spark, d):
    s = F.coalesce(F.get_json_object("props", "$.score"), F.get_json_object("props", "$.k")).cast("double")
    return table(spark, d, "events").where("event_type = 'view'").agg(half_up(F.avg(s), 4).alias("score"))


@query("ag59_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return rel.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("ag60_conditional_count", "SELECT count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("a"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("wn1_row_number_dedup", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def _(spark, d):
    return rel.latest(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), F.asc("l_partkey"), F.asc("l_suppkey")]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("wn4_latest_per_group", "SELECT run_id, arg_max(session_id, (started_ms, session_id)) AS session_id FROM sessions GROUP BY 1", "sessions")
def _(spark, d):
    return view(spark, d, "sessions").groupBy("run_id").agg(F.max_by("session_id", F.struct("started_ms", "session_id")).alias("session_id"))


@query("wn6_serial_number", "SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS serial FROM supplier")
def _(spark, d):
    from tessella.operators.numbering import global_row_number

    return global_row_number(table(spark, d, "supplier"), ["s_nationkey", "s_suppkey"], "serial").select("s_suppkey", "serial")


@query("wn16_next_numbers", "SELECT event_id, coalesce(m.top, 0) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number FROM events LEFT JOIN (SELECT c_custkey, max(c_nationkey) AS top FROM customer GROUP BY 1) m ON user_id = m.c_custkey")
def _(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("number"))
    return rel.next_numbers(table(spark, d, "events"), base, "user_id", "number", ["event_id"]).select("event_id", "number")


@query("st1_multi_key_order", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey")


@query("st2_offset_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(spark, d):
    return rel.page_of(table(spark, d, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, 50).select("o_orderkey")


@query("st2b_page_count", "SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM orders")
def _(spark, d):
    return rel.page_count(table(spark, d, "orders"), 50)


@query("st3_cursor_page", "SELECT event_id FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-20', 100000000) ORDER BY ts DESC, event_id DESC LIMIT 26")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    at = F.expr("timestamp_ntz'2024-01-20'")
    return e.where((F.col("ts") < at) | ((F.col("ts") == at) & (F.col("event_id") < 100000000))).orderBy(F.desc("ts"), F.desc("event_id")).limit(26).select("event_id")


@query("st4_top_recent", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def _(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "event_type")


@query("st5_nulls_last", "SELECT issue_id, page FROM issues ORDER BY page ASC NULLS LAST, ts_ms, issue_id LIMIT 40", "issues")
def _(spark, d):
    return view(spark, d, "issues").orderBy(F.asc_nulls_last("page"), "ts_ms", "issue_id").limit(40).select("issue_id", "page")


@query("st6_dotted_numbers", "SELECT code, row_number() OVER (ORDER BY a, b, code) AS place FROM (SELECT DISTINCT 'c' || '.' AS x, (page % 4 + 1) || '.' || (page % 13 + 1) AS code, page % 4 + 1 AS a, page % 13 + 1 AS b FROM issues WHERE page IS NOT NULL)", "issues")
def _(spark, d):
    from pyspark.sql import Window

    codes = view(spark, d, "issues").where("page IS NOT NULL").select(F.concat_ws(".", (F.col("page") % 4 + 1).cast("string"), (F.col("page") % 13 + 1).cast("string")).alias("code")).distinct()
    return codes.select("code", F.row_number().over(Window.orderBy(F.transform(F.split("code", r"\."), lambda x: x.cast("int")), "code")).alias("place"))


@query("set1_distinct", "SELECT DISTINCT c_mktsegment FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_mktsegment").distinct()


@query("set2_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def _(spark, d):
    return rel.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("set3_distinct_order", "SELECT DISTINCT p_brand, p_type FROM part ORDER BY 1, 2")
def _(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct().orderBy("p_brand", "p_type")


@query("set4_union_all", "SELECT 'customer' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier")
def _(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("k"))
    return a.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("k")))


@query("set5_remapped_union", "SELECT issue_id, CASE severity WHEN 'critical' THEN 'ERROR' WHEN 'serious' THEN 'ERROR' ELSE 'WARNING' END AS level FROM issues WHERE source_no = 0 UNION ALL SELECT issue_id, 'INFO' FROM issues WHERE source_no = 1", "issues")
def _(spark, d):
    i = view(spark, d, "issues")
    a = i.where("source_no = 0").select("issue_id", F.when(F.col("severity").isin("critical", "serious"), "ERROR").otherwise("WARNING").alias("level"))
    return a.unionByName(i.where("source_no = 1").select("issue_id", F.lit("INFO").alias("level")))


@query("set8_cross_set_dedup", "SELECT file_id, code, min(issue_id) AS issue_id FROM issues GROUP BY 1, 2", "issues")
def _(spark, d):
    return rel.latest(view(spark, d, "issues"), ["file_id", "code"], [F.asc("issue_id")]).select("file_id", "code", "issue_id")


@query("set9_pages_without_zones", "WITH n AS (SELECT run_id, max(page_number) AS last FROM zones GROUP BY 1), e AS (SELECT run_id, unnest(generate_series(1, last)) AS page_number FROM n) SELECT run_id, page_number FROM e EXCEPT SELECT run_id, page_number FROM zones WHERE page_number % 3 <> 0", "zones")
def _(spark, d):
    z = view(spark, d, "zones")
    last = z.groupBy("run_id").agg(F.max("page_number").alias("last"))
    return rel.missing_numbers(z.where("page_number % 3 <> 0").join(last, "run_id"), ["run_id"], "page_number", "last")


@query("set10_minus_reviewed", "SELECT issue_id FROM issues WHERE message NOT IN (SELECT 'message ' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey < 9)", "issues")
def _(spark, d):
    done = table(spark, d, "nation").where("n_nationkey < 9").select(F.concat(F.lit("message "), F.col("n_nationkey").cast("string")).alias("message"))
    return view(spark, d, "issues").join(done, "message", "left_anti").select("issue_id")


@query("set11_minus_names", "SELECT p_name FROM part GROUP BY 1 HAVING p_name NOT IN (SELECT p_name FROM part WHERE p_size < 10)")
def _(spark, d):
    p = table(spark, d, "part")
    return p.select("p_name").distinct().join(p.where("p_size < 10").select("p_name").distinct(), "p_name", "left_anti")


@query("set13_exists_flag", "SELECT EXISTS(SELECT 1 FROM orders WHERE o_orderstatus = 'X') AS has_x, EXISTS(SELECT 1 FROM orders WHERE o_orderstatus = 'F') AS has_f")
def _(spark, d):
    return table(spark, d, "orders").agg(*[(F.count_if(F.col("o_orderstatus") == s) > 0).alias(f"has_{s.lower()}") for s in "XF"])


@query("snk2_upsert", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'changed' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 1000 + r_regionkey, 'added' FROM region")
def _(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    new = table(spark, d, "region").select((F.col("r_regionkey") + 1000).alias("n_nationkey"), F.lit("added").alias("n_name"))
    return rel.upsert(n, n.where("n_nationkey % 3 = 0").withColumn("n_name", F.lit("changed")).unionByName(new), ["n_nationkey"])


@query("snk3_update_where", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE s_name END AS s_name FROM supplier")
def _(spark, d):
    return rel.update_where(table(spark, d, "supplier"), F.col("s_acctbal") < 0, s_name="debt").select("s_suppkey", "s_name")


@query("snk4_counter_from_events", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("snk5_replace_group", "SELECT n_regionkey, n_name FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 1, 'only'")
def _(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", "n_name")
    return rel.replace_group(n, n.where("n_regionkey = 1").groupBy("n_regionkey").agg(F.lit("only").alias("n_name")), ["n_regionkey"])


@query("snk14_rows_as_json", "SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS row_json FROM region")
def _(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("row_json"))


@query("xs1_seeded_sample")
def _(spark, d):
    return rel.sample_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 50, 42, "o_orderkey")


@query("xs5_blended_cost", "WITH j AS (SELECT count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-08'), u AS (SELECT sum(ms) / 3600000.0 AS h FROM (SELECT lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts) // 1000 AS ms, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE event_type = 'signup' AND nxt = 'error') SELECT n, floor(h * 0.5 / nullif(n, 0) * 1000000.0 + 0.5) / 1000000.0 AS cost FROM j, u")
def _(spark, d):
    from tessella.operators.logs import blended_cost, intervals

    e = view(spark, d, "workflow_events")
    up = intervals(e, ["workflow_id"], "ts_ms", "event_id", F.col("state") == "signup", F.col("state") == "error")
    n = e.where("ts BETWEEN timestamp_ntz'2024-01-05' AND timestamp_ntz'2024-01-08'").agg(F.count("*").alias("n"))
    return blended_cost(up, n, 0.5)


@query("xs6_link_split", "SELECT l_orderkey, CASE WHEN p_partkey IS NULL THEN 'dangling' ELSE 'valid' END AS link, count(*) AS n FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0) ON l_partkey = p_partkey GROUP BY ALL")
def _(spark, d):
    p = table(spark, d, "part").where("p_partkey % 4 <> 0").select("p_partkey")
    li = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return li.groupBy("l_orderkey", F.when(F.col("p_partkey").isNull(), "dangling").otherwise("valid").alias("link")).agg(F.count("*").alias("n"))


@query("xs8_union_anti", "SELECT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) ON k = n_nationkey WHERE n_nationkey IS NULL")
def _(spark, d):
    k = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()
    return k.join(table(spark, d, "nation").where("n_regionkey < 3"), F.col("k") == F.col("n_nationkey"), "left_anti")


@query("xs9_composite_unique", "SELECT count(DISTINCT CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR)) AS pairs, count(*) AS n FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.countDistinct("l_orderkey", "l_linenumber").alias("pairs"), F.count("*").alias("n"))


@query("xs10_health_table", "SELECT 'orders' AS name, CASE WHEN EXISTS(SELECT 1 FROM orders) THEN 'OK' ELSE 'MISSING' END AS status UNION ALL SELECT 'debts', CASE WHEN EXISTS(SELECT 1 FROM supplier WHERE s_acctbal < -100000) THEN 'OK' ELSE 'MISSING' END")
def _(spark, d):
    ok = F.when(F.count("*") > 0, "OK").otherwise("MISSING")
    a = table(spark, d, "orders").agg(ok.alias("status")).select(F.lit("orders").alias("name"), "status")
    return a.unionByName(table(spark, d, "supplier").where("s_acctbal < -100000").agg(ok.alias("status")).select(F.lit("debts").alias("name"), "status"))


@query("xs11_defaults", "SELECT issue_id, coalesce(page, 0) AS page FROM issues", "issues")
def _(spark, d):
    return view(spark, d, "issues").fillna(0, ["page"]).select("issue_id", "page")


@query("lx21_array_overlap", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'bolt'])")
def _(spark, d):
    return table(spark, d, "part").where(F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("bolt")))).select("p_partkey")


@query("xs12_review_queue", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND list_has_any(string_split(p_name, ' '), ['red', 'ring']) ORDER BY p_size, p_retailprice DESC, p_partkey LIMIT 50")
def _(spark, d):
    p = table(spark, d, "part").where(F.col("p_size").between(10, 20) & F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring"))))
    return p.orderBy("p_size", F.desc("p_retailprice"), "p_partkey").limit(50).select("p_partkey")
