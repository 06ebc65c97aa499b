"""Rules as table functions against patterns, and against plain Python where they look back."""

import random
import re

import pytest
from pyspark.errors import AnalysisException

from tessella.operators import documents as doc
from tessella.operators import rule_functions as rf
from tessella.sources.tables import table

PATTERNS = {"space": r"\.\s{2,}", "serial": r"(\w+),\s+(\w+)\s+and\s+(\w+)", "small": r"(?<![a-z])[a-z]{2}(?![a-z])"}


@pytest.fixture(scope="module")
def rules(spark):
    rf.register(spark, "style_check", {n: rf.by_pattern(p) for n, p in PATTERNS.items()} | {"first": rf.first_use(r"\b[A-Z]{2,6}\b")})


def test_lateral_as_patterns(spark, sf, rules):
    table(spark, sf, "documents").createOrReplaceTempView("texts")
    names = ",".join(PATTERNS)
    got = spark.sql(f"SELECT doc_id, r.* FROM texts, LATERAL style_check(text, '{names}') AS r")
    want = doc.apply_rules(table(spark, sf, "documents"), "doc_id", "text", list(PATTERNS.items()))
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and {r[1] for r in rows} >= {"small", "serial"}


def test_partitions_in_order(spark, rules):
    rng = random.Random(8)
    words = ["NATO", "EU", "(UN)", "UN", "(EU)", "the", "(ABCDEFG)", "AB"]
    rows = [(k, n, " ".join(rng.choices(words, k=rng.randint(0, 4))) if rng.random() > 0.1 else None, "x") for k in (*range(20), None) for n in range(rng.randint(0, 9))]
    spark.createDataFrame(rng.sample(rows, len(rows)), "k long, n int, body string, extra string").createOrReplaceTempView("lines")
    got = spark.sql("SELECT * FROM style_check(TABLE(SELECT * FROM lines) PARTITION BY (k) ORDER BY (n), 'body', 'first')")
    assert got.columns == ["k", "n", "extra", "rule", "start", "end", "match"]
    want, seen = [], {}
    for k, n, body, extra in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        for m in re.finditer(r"\b[A-Z]{2,6}\b", body or ""):
            if m[0] not in seen.setdefault(k, set()):
                seen[k].add(m[0])
                if body[m.start() - 1 : m.start()] != "(":
                    want.append((k, n, extra, "first", *m.span(), m[0]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and want
    assert spark.sql("SELECT * FROM style_check(TABLE(SELECT * FROM lines WHERE false) PARTITION BY (k) ORDER BY (n), 'body')").count() == 0


def test_calls_that_cannot_be(spark, rules):
    spark.createDataFrame([(1, "a", "b")], "k int, text string, rule string").createOrReplaceTempView("odd")
    for call in ("style_check('a', 'none')", "style_check(TABLE(SELECT k, text FROM odd), 'body')", "style_check(TABLE(SELECT k, text FROM odd), 'text', 'none')", "style_check(TABLE(odd))"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {call}").collect()
    assert spark.sql("SELECT rule, match FROM style_check('in a EU', 'small,first') ORDER BY 1").collect() == [("first", "EU"), ("small", "in")]
    assert spark.sql("SELECT * FROM style_check(CAST(NULL AS STRING))").count() == 0
