"""Free-text search of works against scoring all pairs."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tessella.operators import reference_search as rs


def _best(queries, works, k):
    have = {i: Counter(t) for i, t in works.items() if t}
    df = Counter(w for c in have.values() for w in c)
    mean = sum(sum(c.values()) for c in have.values()) / max(len(have), 1)
    out = []
    for q, terms in queries.items():
        scores = []
        for i, c in have.items():
            n = sum(c.values())
            s = sum(math.floor(1000 * math.log(1 + (len(have) - df[t] + 0.5) / (df[t] + 0.5)) * 2.2 * c[t] / (c[t] + 1.2 * (0.25 + 0.75 * n / mean)) + 1e-9) for t in set(terms) if t in c)
            if set(terms) & set(c):
                scores.append((-s, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_against_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)]
    works = {i: rng.choices(words, k=rng.choice([0, 1, 3, 12, 60])) for i in range(400)}
    works |= {1000 + i: ["w1", "w2", "w9"] for i in range(30)} | {2000 + i: ["w1"] * 40 for i in range(300)}
    queries = {i: rng.choices([*words, "nowhere"], k=rng.choice([0, 1, 2, 8, 40])) for i in range(300)}
    w = spark.createDataFrame([*works.items(), (None, ["w1"])], "score long, rank array<string>").repartition(5)
    q = spark.createDataFrame([*queries.items(), (None, ["w1"]), (900, None), *list(queries.items())[:20]], "work long, term array<string>")
    index = rs.postings(w, "score", F.col("rank"))
    for k in (1, 5):
        got = sorted(map(tuple, rs.search(q, "work", F.col("term"), index, k).collect()))
        assert got == sorted(_best(queries, works, k))
    assert rs.search(q.limit(0), "work", F.col("term"), index).count() == 0
    assert rs.search(q, "work", F.col("term"), rs.postings(w.limit(0), "score", F.col("rank"))).count() == 0


def test_frequent_words_find_no_candidates(spark):
    works = spark.createDataFrame([(i, ["the", f"x{i % 50}"]) for i in range(1000)], "id long, t array<string>")
    index = rs.postings(works, "id", F.col("t"))
    got = rs.search(spark.createDataFrame([(7, ["the", "x7"])], "q long, t array<string>"), "q", F.col("t"), index)
    assert [r["work"] for r in got.orderBy("rank").collect()] == [7, 57, 107, 157, 207]


def test_shards_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7)) % 200}" for _ in range(2000)]
    works = {f"x{i}": rng.choices(words, k=rng.choice([1, 5, 30])) for i in range(150)}
    queries = {i: rng.choices(words, k=rng.choice([1, 4, 25])) for i in range(60)}
    w, q = spark.createDataFrame([*works.items()], "work string, t array<string>"), spark.createDataFrame([*queries.items()], "q long, t array<string>")
    monkeypatch.setattr(rs, "SHARD_POSTINGS", 300)
    found = rs.search(q, "q", F.col("t"), rs.postings(w, "work", F.col("t")), 4)
    assert sorted(map(tuple, found.collect())) == sorted(_best(queries, works, 4))


def test_pairs_of_query_and_work_are_never_rows(spark):
    index = spark.createDataFrame([(i, t, 5) for i in range(50) for t in ("a", "b")], "work long, term string, w long")
    found = rs.search(spark.createDataFrame([(i, ["a", "b"]) for i in range(50)], "q long, t array<string>"), "q", F.col("t"), index, 2)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.where("score = 10").count() == 100
