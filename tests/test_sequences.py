"""Numbers missing from sequences, with spans far wider than an array may be."""

from pyspark.sql import functions as F

from tessella.operators import citations as cit
from tessella.operators import relational as rel


def test_wide_spans(spark):
    df = spark.createDataFrame([(1, 5, 9), (2, 0, 199_999), (3, 7, 6), (4, None, 3), (5, -2, -2)], "k long, a long, b long")
    got = rel.numbers_between(df, F.col("a"), F.col("b"), "n")
    assert {tuple(r) for r in got.groupBy("k").agg(F.count("*"), F.min("n"), F.max("n"), F.countDistinct("n")).collect()} == {(1, 5, 5, 9, 5), (2, 200_000, 0, 199_999, 200_000), (5, 1, -2, -2, 1)}
    assert sorted(r["n"] for r in rel.numbers_between(df.where("k = 1"), F.col("a"), F.col("b"), "n", step=2).collect()) == [5, 6, 7, 8, 9]


def test_sequence_issues(spark):
    n = spark.createDataFrame([("a", 1, 1), ("a", 2, 4), ("a", 3, 2), ("a", 4, 1), ("b", 1, 30_000_000), ("b", 2, 1)], "book string, at int, number int")
    got = cit.sequence_issues(n, "book", ["at"])
    assert got.schema["number"].dataType.simpleString() == "int"
    assert sorted(map(tuple, got.where("book = 'a'").collect())) == [("a", "missing", 3), ("a", "out-of-order", 2), ("a", "reused", 1)]
    assert {tuple(r) for r in got.where("book = 'b'").groupBy("kind").count().collect()} == {("missing", 29_999_998), ("out-of-order", 1)}
    assert cit.sequence_issues(n.limit(0), "book", ["at"]).count() == 0
