"""Hand-valued cases of functions, chunkers, rules, scores and splits."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry, labels, numbers, text
from tessella.operators import documents as doc
from tessella.operators import export, issues, logs, timesheets


def _one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0).alias("_")])
    return df.select(column).first()[0]


@pytest.mark.parametrize(("x", "want"), [(-2.5, -2.0), (2.5, 3.0), (0.49, 0.0), (-0.5, 0.0)])
def test_halves_go_up(spark, x, want):
    assert _one(spark, numbers.half_up("x"), x=x) == want


def test_percentiles_and_medians(spark):
    df = spark.createDataFrame([(v,) for v in (40, 10, 30, 20)], "v long")
    assert tuple(df.agg(numbers.nearest_rank("v", 0.5), numbers.nearest_rank("v", 0.9), numbers.upper_median("v")).first()) == (20, 40, 30)


def test_rates_of_nothing(spark):
    assert _one(spark, numbers.rate(F.lit(1), F.lit(0))) == 0.0
    assert _one(spark, numbers.rate(F.lit(1), F.lit(0), empty=None)) is None


@pytest.mark.parametrize(("html", "want"), [("<p>a</p><p>b &amp; c</p>", "a\nb & c"), ("x<style>p{}</style>y<script>var t='</p>'</script>z", "xyz"), ("&mdash;&#8212;&#x2014;&nope;", "———&nope;"), ("a<br/>b  <b>c</b>", "a\nb c")])
def test_html_to_text(spark, html, want):
    assert _one(spark, text.html_to_text(F.col("h")), h=html) == want


def test_citation_numbers(spark):
    assert _one(spark, text.citation_numbers(F.col("t")), t="[1, 3–5; 9]") == [1, 3, 4, 5, 9]
    assert _one(spark, text.citation_numbers(F.col("t")), t="1-900") == [1, 900]
    assert _one(spark, text.number_ranges(F.array(*[F.lit(i) for i in (5, 1, 2, 3, 8, 9)]))) == "1-3,5,8,9"
    assert _one(spark, text.to_superscript(F.lit(204))) == "²⁰⁴"
    assert _one(spark, text.doi(F.col("t")), t="at doi 10.1000/xyz.12). Next") == "10.1000/xyz.12"


def test_guards(spark):
    assert [_one(spark, text.csv_safe(F.col("t")), t=t) for t in ("=1", "-2", "a", "")] == ["'=1", "'-2", "a", ""]
    assert _one(spark, text.strip_control(F.col("t")), t="\x00\x07") is None
    assert _one(spark, numbers.duration_text(F.lit(3_725_000))) == "1h 2m"


def test_labels(spark):
    assert [_one(spark, labels.canonical(F.col("t")), t=t) for t in ("H2", "Page Header", "TABLE", "odd")] == ["section-header", "header", "table", None]
    assert [_one(spark, labels.by_machine(F.col("t")), t=t) for t in ("ai:x", "auto-annotation", "ann")] == [True, True, False]
    assert _one(spark, labels.by_machine(F.lit(None).cast("string"))) is False


def test_contrast(spark):
    assert _one(spark, geometry.contrast_ratio(F.lit("#000000"), F.lit("#ffffff"))) == pytest.approx(21.0)


def test_chunkers():
    assert doc.cut_text("", 5) == []
    assert "".join(c for _, c in doc.cut_text("One. Two. Three. Four", 9)) == "One. Two. Three. Four"
    assert doc.cut_text("aaaa\n\nbbbb", 7) == [(0, "aaaa\n\n"), (6, "bbbb")]
    assert [c for _, c in doc.pack_sentences("A b. C d. E f g h i.", 4)] == ["A b. C d. ", "E f g h i."]
    with pytest.raises(ValueError):
        doc.cut_text("x", 0)


def test_sequence_similarity():
    assert doc.sequence_similarity("a b c d", "a c d b") == 0.75
    assert doc.sequence_similarity("", "x") == 0.0 and doc.sequence_similarity("x y", "x y") == 1.0
    long = " ".join(f"w{i % 50}" for i in range(2100))
    assert 0.9 < doc.sequence_similarity(long, long + " z") <= 1.0


def test_rules(spark):
    docs = spark.createDataFrame([(1, "Utilize 5 percent.  we saw 12-14 whilst"), (2, "x" * 200_000)], "doc_id long, text string")
    got = {(r["rule"], r["start"], r["end"]) for r in doc.apply_rules(docs, "doc_id", "text", [(r[0], r[3]) for r in doc.STYLE_RULES]).collect()}
    assert {("term-utilize", 0, 7), ("num-percent", 8, 17), ("punct-double-space", 17, 20), ("chicago-en-dash", 27, 32), ("chicago-whilst", 33, 39)} <= got
    assert not doc.safe_pattern("(a+)+") and not doc.safe_pattern("(") and doc.safe_pattern("a+b")
    house = [{"id": "t", "kind": "TERMINOLOGY", "avoid": "whilst"}, {"id": "c", "kind": "CAPITALIZATION", "term": "Utilize"}]
    assert {r["rule"] for r in doc.house_rules(docs, "doc_id", "text", house).collect()} == {"t"}


def test_page_audit(spark):
    pages = spark.createDataFrame([(1, '<html><body><img src="x"><h1>a</h1><h3>b</h3><a href="#"> </a><table><tr><td></td></tr></table></body></html>'), (2, '<html lang="en"><main><img alt="" src="x"><h1>a</h1><h2>b</h2></main></html>')], "page_id long, html string")
    got = {(r["page_id"], r["code"]) for r in doc.audit_pages(pages, "page_id", "html").collect()}
    assert got == {(1, c) for c in ("EPUB-SEM-001", "EPUB-SEM-002", "EPUB-IMG-001", "EPUB-STRUCT-002", "EPUB-STRUCT-003", "EPUB-STRUCT-004")}


def test_scores_floor_at_zero(spark):
    df = spark.createDataFrame([(1, "critical")] * 9 + [(2, "minor")], "file_id long, severity string")
    assert {r["file_id"]: r["score"] for r in issues.scores(df, ["file_id"]).collect()} == {1: 0, 2: 99}


def test_three_tier_dedup_lets_dropped_rows_suppress_nothing(spark):
    rows = [(1, 1, "a", 0, 5, "short"), (1, 2, "b", 0, 5, "a long enough text"), (1, 3, "c", 9, 12, "a long enough text"), (1, 4, "a", 0, 5, "short")]
    df = spark.createDataFrame(rows, "file_id long, issue_id long, rule string, start long, end long, match string")
    assert sorted(r["issue_id"] for r in issues.three_tier_dedup(df, ["file_id"], ["issue_id"]).collect()) == [1, 3]


def test_audit_comparison(spark):
    before = spark.createDataFrame([(1, 1, "X", "p1", "minor"), (1, 2, "X", "p2", "minor"), (1, 3, "Y", "p1", "minor")], "file_id long, issue_id long, code string, location string, severity string")
    after = spark.createDataFrame([(1, 10, "X", "p1", "minor"), (1, 11, "X", "p9", "minor"), (1, 12, "Z", "p1", "critical")], before.schema)
    got = {(r["status"], r["count"]) for r in issues.compare_audits(before, after, ["file_id"], "issue_id").groupBy("status").count().collect()}
    assert got == {("remaining", 2), ("resolved", 1), ("regression", 1)}


def test_issues_without_a_place_are_alike_in_place(spark):
    kind = "file_id long, issue_id long, code string, location string, severity string"
    before = spark.createDataFrame([(1, 1, "X", None, "minor"), (1, 2, "X", None, "minor")], kind)
    after = spark.createDataFrame([(1, 10, "X", None, "serious"), (1, 11, "Y", None, "minor")], kind)
    got = sorted((r["status"], r["severity"]) for r in issues.compare_audits(before, after, ["file_id"], "issue_id").collect())
    assert got == [("regression", "minor"), ("remaining", "minor"), ("resolved", "minor")]


def test_sequence_issues(spark):
    from tessella.operators import citations

    rows = [("a", 1, 1), ("a", 2, 5), ("a", 3, 2), ("a", 4, 5), ("b", 1, 7), (None, 1, 1), (None, 2, 3)]
    got = citations.sequence_issues(spark.createDataFrame(rows, "book string, at int, number int"), "book", ["at"]).collect()
    want = [(None, "missing", 2), ("a", "missing", 3), ("a", "missing", 4), ("a", "out-of-order", 2), ("a", "reused", 5)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_shares_sum_to_the_pool(spark):
    df = spark.createDataFrame([("a", i, w) for i, w in enumerate((1, 1, 1))] + [("b", 0, 0)], "k string, i long, w long")
    got = timesheets.distribute(df, ["k"], F.lit(100), "w", ["i"]).collect()
    assert [r["share"] for r in sorted(got, key=lambda r: (r["k"], r["i"]))] == [34, 33, 33, 0]


def test_costs_of_titles_sum_to_the_total(spark, sf):
    from tessella.sources.tables import table, view

    s = view(spark, sf, "sessions")
    runs = table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS run_id", "n_name AS name")
    each = timesheets.per_title(s, runs, view(spark, sf, "issues").selectExpr("file_id % 16 AS run_id")).agg(F.sum("cost")).first()[0]
    assert each == pytest.approx(timesheets.totals(s).first()["cost"])


def test_recommendations(spark):
    def ap(*v):
        return spark.createDataFrame([(c, float(x)) for c, x in zip(labels.CANONICAL, v, strict=True)], "zone_type string, ap double")

    base = ap(*[0.5] * 11)
    assert export.model_delta(base, ap(*[0.51] * 11)).first()["recommendation"] == "PROCEED"
    assert export.model_delta(base, ap(*[0.501] * 11)).first()["recommendation"] == "HOLD"
    worse = export.model_delta(base, ap(0.4, *[0.6] * 10)).first()
    assert worse["recommendation"] == "HOLD" and worse["worst_class"] == "paragraph"


def test_log_intervals(spark):
    lines = spark.createDataFrame([("2024-01-01T10:00:00Z scaler desired=1",), ("2024-01-01T10:30:00Z scaler desired=1",), ("2024-01-01T11:00:00Z x desired=0",), ("noise",), ("2024-01-01T12:00:00Z x desired=1",)], "value string")
    e = logs.parse_lines(lines).selectExpr("1 AS k", "unix_millis(ts) AS ms", "state")
    spans = logs.intervals(e, ["k"], "ms", "ms", F.col("state") == 1, F.col("state") == 0)
    assert [r["end"] - r["start"] for r in spans.collect()] == [1_800_000]
    assert logs.blended_cost(spans, spark.createDataFrame([(0,)], "n long"), 2.0).first()["cost"] is None
    assert logs.blended_cost(spans, spark.createDataFrame([(4,)], "n long"), 2.0).first()["cost"] == 0.25


def test_strict_numbers_and_entries(spark):
    from tessella.operators import citations

    got = [_one(spark, citations.strict_numbers(F.col("t")), t=t) for t in ("a [1, 2] (9)", "(3–5)", "7", "[1-99]", "1999 x")]
    assert got == [[1, 2], [3, 4, 5], [7], [1], []]
    docs = spark.createDataFrame([(1, "Body\nReferences\n1. First entry here\n2) Second entry\n   goes on\n3. Third entry here\n\nAppendix\nmore"), (2, "Body\nBibliography\nSome author, a long title.\n\nOther author, another title."), (3, "none")], "id long, t string")
    rows = sorted((r["id"], r["number"], r["entry"]) for r in citations.reference_entries(docs, "id", "t").collect())
    assert rows == [(1, 1, "First entry here"), (1, 2, "Second entry goes on"), (1, 3, "Third entry here"), (2, 1, "Some author, a long title."), (2, 2, "Other author, another title.")]


def test_layout(spark):
    from tessella.operators import layout

    z = spark.createDataFrame([(1, 1, "figure", 0.0, 0.0, 50.0, 50.0), (1, 2, "caption", 10.0, 52.0, 30.0, 10.0), (1, 3, "caption", 10.0, 70.0, 30.0, 6.0), (1, 4, "caption", 200.0, 0.0, 9.0, 9.0)], "page long, o long, zone_type string, x double, y double, w double, h double")
    got = {r["o"]: (r["y"], r["h"]) for r in layout.absorb_captions(z, ["page"], ["o"]).collect()}
    assert got == {1: (0.0, 76.0), 4: (0.0, 9.0)}  # the first caption brings the figure within reach of the second
    lines = spark.createDataFrame([(1, i, float(x), 30.0) for i, x in enumerate((0, 300, 10, 310, 20, 320, 900))], "page long, o long, x double, w double")
    assert sorted(r["n"] for r in layout.column_groups(lines, ["page"], ["o"]).collect()) == [3, 3]
    assert [_one(spark, layout.tag_class(F.col("t"), {"Head": "H2", "A": "P", "B": "P"}), t=t) for t in ("Head", "Sect", "Odd")] == ["section-header", None, "paragraph"]
