"""The last mark before a point, against looking at all of them."""

import random

from tessella.operators import relational as rel
from tessella.plans import QUERIES


def test_last_before_by_brute_force(spark):
    rng = random.Random(5)
    marks = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(-40, 400, 7)]), i) for i in range(60)]
    marks += [(1, 50, 900), (1, 50, 901), (4, 10, 902)]
    points = [(i, rng.choice([1, 2, 3, 4, 5, None]), rng.choice([None, *range(-60, 600)])) for i in range(400)]
    want = []
    for i, book, at in points:
        before = [(lo, c) for b, lo, c in marks if b is not None and b == book and lo is not None and at is not None and lo <= at]
        want.append((i, max(before)[1] if before else None))
    p, m = spark.createDataFrame(points, "i int, book int, at long"), spark.createDataFrame(marks, "book int, lo long, chapter int")
    for cell in (1, 16, 10_000):
        got = rel.last_before(p, m, ["book"], "at", "lo", ["chapter"], cell)
        assert sorted(((r["i"], r["chapter"]) for r in got.collect()), key=lambda x: x[0]) == want
    assert rel.last_before(p, m.limit(0), ["book"], "at", "lo", ["chapter"], 16).where("chapter IS NOT NULL").count() == 0


def test_places_in_chapters_make_no_pairs(spark, sf):
    assert "Join" not in QUERIES["jn16_offset_in_chapter"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
