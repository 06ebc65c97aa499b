"""Common subsequences by bits against the table, pairs of long texts, the other measure on request."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tessella.operators import documents as doc


def _table(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]


def test_subsequence_by_table():
    rng = random.Random(2)
    for _ in range(600):
        words = [f"w{i}" for i in range(rng.choice([1, 2, 5, 40]))]
        x, y = ([rng.choice(words) for _ in range(rng.randint(0, 90))] for _ in "ab")
        assert doc.common_subsequence(x, y) == doc.common_subsequence(y, x) == _table(x, y)


def test_long_pairs(spark):
    rng = random.Random(3)
    x = [f"w{rng.randrange(500)}" for _ in range(20_000)]
    kept = sorted(rng.sample(range(20_000), 12_000))
    y = [x[i] for i in kept]
    z = y[:6_000] + ["new"] * 10_000 + y[6_000:]
    pairs = spark.createDataFrame([(1, " ".join(x), " ".join(y)), (2, " ".join(z), " ".join(y)), (3, None, "a"), (4, None, None), (5, "A, b", "a B."), (6, "!", "?"), (7, "a b c d", "d a b c")], "id long, rule string, similarity string")
    got = dict(map(tuple, doc.sequence_similarities(pairs, "id", "rule", "similarity").collect()))
    assert got == {1: 0.6, 2: 12 / 22, 3: 0.0, 4: 1.0, 5: 1.0, 6: 0.0, 7: 0.75}
    assert dict(map(tuple, doc.sequence_similarities(pairs, "id", "rule", "similarity", cells=10).where("id = 7").collect())) == {7: 2 / 3}
    assert doc.sequence_similarities(pairs.limit(0), "id", "rule", "similarity").count() == 0


def test_query_by_table(spark, sf):
    from tessella.plans import QUERIES
    from tessella.sources.tables import table

    texts = dict(table(spark, sf, "documents").select("doc_id", "text").collect())
    got = dict(map(tuple, QUERIES["sf4_sequence_similarity"](spark, sf).collect()))
    assert set(got) == {i for i in texts if i + 1 in texts}
    for i in got:
        x, y = (doc._tokens(texts[j] or "") for j in (i, i + 1))
        if len(x) * len(y) < 100_000:
            want = 1.0 if texts[i] == texts[i + 1] else _table(x, y) / max(len(x), len(y)) if x and y else 0.0
            assert got[i] == want


def test_shared_items_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice("abcdé") for _ in range(rng.randint(0, 9))], [rng.choice("abxdé") for _ in range(rng.randint(0, 9))]) for i in range(300)]
    rows += [(300, None, ["a"]), (301, [], []), (302, ["a"] * 5000, ["a"] * 3000 + ["b"]), (302, ["q", None], [None, "q"])]
    df = spark.createDataFrame(rows, "k long, x array<string>, y array<string>")
    for whole in ("union", "max"):
        got = sorted((r["k"], round(r["similarity"], 9)) for r in doc.multiset_overlap(df, "k", F.col("x"), F.col("y"), whole, at_once=40).collect())
        want = []
        for k, x, y in rows:
            p, q = Counter(x or []), Counter(y or [])
            every = sum((p | q).values()) if whole == "union" else max(sum(p.values()), sum(q.values()))
            want.append((k, round(sum((p & q).values()) / every, 9) if every else 0.0))
        assert got == sorted(want)
