"""The audit template: scores, levels, files without issues, nulls; a second kind of audit over the same template."""

from pyspark.sql import functions as F

from tessella.operators import audits as aud


def test_scores_of_all_files(spark):
    files = spark.createDataFrame([(1,), (2,), (3,), (4,)], "f int")
    rows = [(1, "critical"), (1, "critical"), (1, "minor"), (2, "serious"), (2, "moderate"), (2, None), (2, "odd"), (9, "critical")] + [(3, "critical")] * 50
    got = {r["f"]: (r["deduction"], r["score"]) for r in aud.scores(files, spark.createDataFrame(rows, "f int, severity string"), ["f"]).collect()}
    assert got == {1: (31, 69), 2: (12, 88), 3: (750, 0), 4: (0, 100)}


def test_first_criterion_of_a_list_decides(spark):
    lists = [["1.1.1"], ["1.1.1", "1.4.6", "1.4.3"], ["1.4.3", "1.4.6"], [], ["9.1"], ["2.4.10"], ["4.1.2", "3.1.2"], None]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, criteria array<string>").withColumn("code", F.lit("c"))
    got = {r["i"]: (r["level"], r["principle"]) for r in aud.criteria_of(df, ["i"]).collect()}
    assert got == {0: ("A", "Perceivable"), 1: ("AAA", "Perceivable"), 2: ("AA", "Perceivable"), 4: ("A", "Perceivable"), 5: ("AAA", "Operable"), 6: ("AA", "Robust")}


def test_page_audit(spark):
    good = '<html lang="en"><body><main><h1>a</h1><h2>b</h2><img alt="x" src="y"/></main></body></html>'
    bad = '<html><body><h1>a</h1><h4>b</h4><img src="y"/><img src="z"/><a href="#"> </a><table><tr><td>1</td></tr></table></body></html>'
    pages = spark.createDataFrame([(1, "x", good), (1, "y", bad), (2, "x", None), (2, "z", "")], "book int, part string, markup string")
    audit = aud.PageAudit("book", "part", html="markup")
    got = {(r["book"], r["part"]): r for r in audit.run(pages).collect()}
    assert len(got) == 4
    g, b, n = got[1, "x"], got[1, "y"], got[2, "x"]
    assert (g["score"], g["n_issues"], g["codes"], g["level"], g["passed"]) == (100, 0, "", None, True)
    assert (b["n_critical"], b["n_serious"], b["n_moderate"], b["n_minor"]) == (2, 2, 2, 1) and b["deduction"] == 55 and b["score"] == 45
    assert b["level"] == "AA" and not b["passed"] and b["codes"].split(",") == sorted(["EPUB-SEM-001", "EPUB-SEM-002", "EPUB-IMG-001", "EPUB-STRUCT-002", "EPUB-STRUCT-003", "EPUB-STRUCT-004"])
    assert (n["score"], n["codes"]) == (91, "EPUB-SEM-001,EPUB-STRUCT-004") and got[2, "z"]["score"] == 91
    assert audit.run(pages.limit(0)).count() == 0


class Lengths(aud.Audit):
    def parse(self, files):
        return files.select(*self.key, F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"))

    def validate(self, parsed):
        short = parsed.where("n_chars < 3")
        return short.select(*self.key, F.lit("SHORT").alias("code"), F.lit("serious").alias("severity"), F.array().cast("array<string>").alias("criteria"), F.lit(1).cast("long").alias("n"))


def test_another_kind_of_audit(spark):
    docs = spark.createDataFrame([("a", "long enough"), ("b", "no"), ("c", None)], "id string, text string")
    got = {r["id"]: (r["score"], r["passed"], r["level"]) for r in Lengths("id").run(docs).collect()}
    assert got == {"a": (100, True, None), "b": (92, False, None), "c": (92, False, None)}
