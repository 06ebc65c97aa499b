"""Numbers of all rows against a sort: hot values, nulls, ties, second columns that are no numbers, few and no rows."""

import random

import pytest

from tessella.operators.numbering import global_row_number, parts


def _key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_numbers_by_a_sort(spark, kind):
    rng = random.Random(4)
    second = (lambda: rng.randint(0, 400)) if kind == "long" else (lambda: f"s{rng.randint(0, 400):03d}")
    rows = [(rng.choice([None, 7, 7, 7, 7, 8, rng.randint(-50, 50)]), rng.choice([None, second()]) if rng.random() < 0.1 else second(), i) for i in range(4_000)]
    df = spark.createDataFrame(rows, f"a long, b {kind}, i long").repartition(3)
    got = {r["n"]: (r["a"], r["b"], r["i"]) for r in global_row_number(df, ["a", "b", "i"], "n", ranges=8).collect()}
    assert [got[k] for k in range(1, 4_001)] == sorted(rows, key=_key)


def test_hot_value_is_cut(spark):
    df = spark.range(9_000).selectExpr("IF(id % 3 > 0, 5, 10000 + id) AS a", "id AS b")
    sizes = [r["count"] for r in parts(df, ["a", "b"], ranges=16).groupBy("_range", "_part").count().collect()]
    assert sum(sizes) == 9_000 and max(sizes) < 9_000 / 12


def test_few_rows(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert global_row_number(df, ["a", "b"], "n").collect()[0]["n"] == 1
    assert global_row_number(df.limit(0), ["a", "b"], "n").count() == 0
    assert global_row_number(df, ["a"], "n").columns == ["a", "b", "n"]
