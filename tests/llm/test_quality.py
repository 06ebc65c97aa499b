"""Rule statistics by brute force; forest and weak labels on held-out labels."""

import re

import numpy as np

from tessella.llm import quality_rules, textstats, weak_quality


def _brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_counts_by_brute_force():
    rng = np.random.default_rng(1)
    pool = ["a", "b", "é", "\n", " ", "\t", "a b c ", "#", "|", "\x85", " ", "Ab", "x\n"]
    for t in ["", "a", "a a a a", "\n\n", *["".join(rng.choice(pool, rng.integers(0, 40))) for _ in range(800)]]:
        assert textstats.count_all(t)[:5] == _brute(t), repr(t)


def _labelled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return docs, labels


def test_rules_on_held_out_labels(spark):
    docs, labels = _labelled(spark, "/root/testdata/sf0.1")
    rules = quality_rules.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("text", "quality").collect()
    counts, good = textstats.table([r[0] for r in rows]), np.array([r[1] for r in rows]) == 1
    failed, _, kept = rules.judge(counts)
    assert kept[good & ~failed].mean() > 0.995
    assert kept[~good].mean() < 0.08


def test_threshold_by_brute_force_over_all_scores(spark):
    rng = np.random.default_rng(5)
    for n, levels in ((1, 5), (40, 7), (9000, 8000)):
        score = rng.integers(1, levels, n) / levels
        good = score + rng.normal(0, 0.2, n) < 0.7
        got = quality_rules.calibrate(spark.createDataFrame([(float(s), bool(g)) for s, g in zip(score, good, strict=True)], "score double, good boolean"))
        if good.all() or not good.any():
            assert got == quality_rules.DEFAULT_THRESHOLD
            continue
        edges = np.r_[0.0, np.unique(score), 1.0]
        cost = [quality_rules.GOOD_WEIGHT * int((good & (score > x)).sum()) + int((~good & (score <= x)).sum()) for x in edges[:-1]]
        widest = max(b - a for a, b, c in zip(edges, edges[1:], cost, strict=False) if c == min(cost))
        assert any(c == min(cost) and b - a == widest and got == (a + b) / 2 for a, b, c in zip(edges, edges[1:], cost, strict=False))


def test_every_labelled_row_counts(spark):
    """9,000 labelled rows, of which no 4,000 tell the median: every one has a say in usual values, leaves and threshold."""
    docs = spark.range(9000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), i -> repeat('x', 1 + CAST((id * 7919 + i * i) % 9 AS INT)) || i || '-' || id)) AS text")
    labels = spark.range(9000).selectExpr("id AS doc_id", "CAST(id % 10 > 0 AS INT) AS quality")
    rules = quality_rules.fit(docs, labels)
    counts = textstats.table([r[0] for r in docs.select("text").collect()])
    shares = quality_rules.shares(counts)
    assert np.allclose(rules.usual[0], np.quantile(shares[:, :2], 0.99, axis=0)) and np.allclose(rules.usual[1], np.median(shares[:, 2:], 0))
    half = [r[0] for r in docs.selectExpr("pmod(xxhash64(CAST(doc_id AS STRING)), 2) = 0").collect()]
    seen = quality_rules.points(counts[np.array(half)], rules.usual)
    for at, (feature, _, _, _, depth) in zip(rules.forest.leaves(seen), rules.forest.trees, strict=True):
        n = np.bincount(at, minlength=len(feature)) / len(seen) * rules.forest.size
        big = (feature < 0) & (n > 2)
        more = quality_rules._usual_depth(n[big])
        assert big.any() and np.allclose(depth[big] - more, np.round(depth[big] - more))


def test_path_lengths_by_brute_force():
    rng = np.random.default_rng(3)
    rows = rng.random((200, 4))
    forest = quality_rules.IsolationForest(rows, trees=20, subsample=32)
    seen = rng.random((50, 4)) * 1.5

    def usual(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    for x, got in zip(seen, forest.anomaly(seen), strict=True):
        total = 0.0
        for feature, cut, left, right, depth in forest.trees:
            at = steps = 0
            while feature[at] >= 0:
                at, steps = (left if x[feature[at]] <= cut[at] else right)[at], steps + 1
            assert depth[at] >= steps  # what the subsample left in a leaf counts on
            total += depth[at]
        assert abs(got - 2 ** (-total / 20 / usual(32))) < 1e-9
    alone = forest.anomaly(np.array([[9.0] * 4, [0.5] * 4]))
    assert alone[0] > alone[1]


def test_ids_of_any_type(spark):
    text = " ".join(f"word{i} of the" for i in range(60))
    docs = spark.createDataFrame([("a", text), ("b", None), (None, "x" * 300_000), ("c", "y" * 2000 + " " + text)], "doc_id string, text string").selectExpr("*", "1 AS id", "2 AS body", "3 AS hash", "4 AS quality")
    labels = spark.createDataFrame([("a", 1), ("c", 0), ("a", 1)], "doc_id string, quality int")
    assert sorted(r["doc_id"] or "" for r in quality_rules.keep_good(docs, labels).collect()) in (["a"], ["a", "c"])
    assert quality_rules.keep_good(docs.limit(0), labels).count() == 0
    got = [weak_quality.classify(docs).select("doc_id", "score").collect() for _ in range(2)]
    assert len(got[0]) == 4 and sorted(map(repr, got[0])) == sorted(map(repr, got[1]))


def test_judge_rows(spark):
    text = " ".join(f"word{i} of the" for i in range(60))
    docs = spark.createDataFrame([(1, text, 1), (2, None, 1), (3, "", 1), (4, "a b " * 40, 1), (1, text, 1)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted((r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in quality_rules.judge(docs, labels).collect())
    assert got == [(1, 180, False, True), (1, 180, False, True), (2, 0, True, False), (3, 0, True, False), (4, 80, True, False)]
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 2
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


def test_weak_labels_without_labels(spark):
    docs, labels = _labelled(spark, "/root/testdata/sf0.1")
    got = weak_quality.classify(docs).join(labels, "doc_id").select("kept", "quality").collect()
    kept, good = np.array([r[0] for r in got]), np.array([r[1] for r in got]) == 1
    assert kept[good].mean() > 0.97 and kept[~good].mean() < 0.2
    assert (kept == good).mean() > 0.95


def test_weak_labels_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "some words of text"), (1, None)], "doc_id long, text string")
    assert weak_quality.classify(docs).count() == 4
    assert weak_quality.classify(docs.limit(0)).count() == 0


def test_estimate_finds_the_reliable_labellers():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.8
    votes = np.column_stack([np.where(rng.random(len(y)) < a, y, ~y) for a in (0.95, 0.9, 0.6)]).astype(int)
    v = np.where(votes == 1, weak_quality.GOOD, weak_quality.BAD)
    patterns, inverse, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    good, rate, share = weak_quality.estimate(patterns, n.astype(float))
    assert abs(share - 0.8) < 0.05
    assert rate[0, 0, weak_quality.GOOD] > 0.9 > rate[0, 2, weak_quality.GOOD]
    assert ((good[inverse.ravel()] > 0.5) == y).mean() > 0.93


def test_ids_of_documents_and_labels_differ_in_type(spark):
    text = " ".join(f"word{i} of the" for i in range(60))
    docs = spark.createDataFrame([("1", text), ("x", text), (None, "")], "doc_id string, text string")
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 0)], "doc_id long, quality int")
    assert sorted(r["doc_id"] for r in quality_rules.keep_good(docs, labels).collect()) == ["1", "x"]
    assert quality_rules.judge(docs.selectExpr("CAST(hash(doc_id) AS DECIMAL(20, 0)) AS doc_id", "text"), labels).count() == 3
