"""Lexical search against brute force; toxicity: scans by brute force, planted rows, held-out labels."""

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import lexical_search, toxicity


def _terms(text):
    return [re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def _brute_search(docs, items, k):
    rows = [(i, t) for i, t in ((i, _terms(t)) for i, t in docs) if t]
    n_docs, n_all = len(rows), sum(len(t) for _, t in rows)
    out = []
    for item, text in items:
        asked = set(_terms(text))
        df = {a: sum(a in t for _, t in rows) for a in asked}
        found = []
        for i, t in rows:
            m = 10 + (90 * len(t) * n_docs) // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[a] + 1))) * ((1000000000 * t.count(a)) // (1000 * t.count(a) + 8 * m)) for a in asked if a in t)
            if s > 0:
                found.append((-s, i is None, i or 0, s))
        out += [(item, r, None if none else i, s) for r, (_, none, i, s) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_terms():
    for t in [None, "", "A-b É ßx_1\x00y\x7fz", "日本 go:Go", "\x85a"]:
        assert [x.decode() for x in lexical_search.terms_of(t)] == _terms(t)


def test_search_by_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = ["the", "The", "of", *[f"w{i}" for i in range(60)], "é", "a-b"]
    share = [40, 10, 25, *[60 / (i + 1) for i in range(60)], 1, 1]
    docs = [(i, " ".join(rng.choices(words, share, k=rng.choice([0, 1, 3, 20, 80])))) for i in range(900)]
    docs += [(i, docs[7][1]) for i in range(900, 1000)] + [(7, docs[7][1]), (None, docs[7][1]), (5000, None), (5001, "the " * 50_000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(40)] + [(90, None), (91, "?!"), (92, "unseen"), (3, "w5 w5 w6"), (None, "w1")]
    rng.shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS terms", "3 AS item_id", "4 AS rank").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS row", "2 AS doc_id")
    want = {k: _brute_search(docs, items, k) for k in (1, 10)}
    for postings, first, last, most, k in ((10**6, 256, 1 << 16, 2000, 10), (300, 4, 64, 2000, 10), (10**6, 1, 8, 11, 1)):
        monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", postings)
        monkeypatch.setattr(lexical_search, "FIRST_BLOCK", first)
        monkeypatch.setattr(lexical_search, "LAST_BLOCK", last)
        monkeypatch.setattr(lexical_search, "ITEMS", most)
        got = sorted((tuple(r) for r in lexical_search.search(table, asked, k).collect()), key=repr)
        assert got == want[k]
    assert lexical_search.search(table.limit(0), asked).count() == 0
    assert lexical_search.search(table, asked.limit(0)).count() == 0


def test_non_essential_lists_are_only_probed():
    """A frequent term of a low bound is looked up for candidates, not scanned, once k documents score higher."""
    n = 20_000
    rare = np.arange(0, n, 400)
    term = np.r_[np.zeros(n, np.int64), np.ones(len(rare), np.int64)]
    doc = np.r_[np.arange(n), rare]
    shard = lexical_search.Shard(np.full(n, 10), term, doc, np.ones(len(doc), np.int64), np.array([5, 9000]), n, 10 * n)
    top, scores = shard.best([0, 1], 10)
    assert top.tolist() == rare[:10].tolist() and len(set(scores.tolist())) == 1
    assert shard.best([0], 3)[0].tolist() == [0, 1, 2]


def _brute_segments(x):
    """All maximal segments by their definition: the best stretch, then the same to its left and right (Ruzzo and Tompa)."""
    best = max(((x[a:b].sum(), -(b - a), a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=None)
    if best is None or best[0] <= 1e-12:
        return []
    _, _, a, b = best
    return _brute_segments(x[:a]) + [(a, b)] + [(b + i, b + j) for i, j in _brute_segments(x[b:])]


def test_segments_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(400):
        x = np.where(rng.random(rng.integers(0, 22)) < 0.4, 1, -1) * rng.random(1)[0].round(3)
        x = x + rng.normal(0, 0.3, len(x))
        got = toxicity.segments(x)
        assert [(a, b) for a, b, _ in got] == _brute_segments(x)
        assert all(abs(s - x[a:b].sum()) < 1e-9 for a, b, s in got)


def test_log_odds_are_careful():
    counts = np.array([[1000, 60, 2, 0], [500, 0, 0, 0], [100, 50, 1, 0]])
    odds = toxicity.log_odds(counts, np.array([10_000, 5000, 1000]))
    assert odds[1] > 1 and odds[0] < 0.2 and odds[2] == odds[3] == 0


def test_rate_is_the_positive_root():
    s, p = np.array([-1.0, 0.5, 2.0]), np.array([0.9, 0.08, 0.02])
    rate = toxicity.tail_rate(s, p)
    assert rate > 0 and abs((p * np.exp(rate * s)).sum() - 1) < 1e-6
    assert toxicity.tail_rate(np.array([1.0]), np.array([1.0])) == 0


def test_words_and_where_they_stand():
    text = "Go go, GO! x1y é_É  İi"
    spans = toxicity.word_spans(text)
    assert [text[a:b] for a, b in spans] == ["Go go, GO", "x", "y", "é_É", "İi"]
    assert len(toxicity.words_of(text)) == len(spans)


def _rows(n, seed):
    rng = random.Random(seed)
    words = [a + b for a in ("ba", "de", "ki", "lo", "mu", "ra", "so") for b in ("n", "st", "ri", "mo", "tal", "ge")]
    out = []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(20, 300))
        bad = i % 6 == 0
        if bad:
            at = rng.randrange(len(w))
            w[at:at] = [f"zug{rng.choice(words)}" for _ in range(3)] if i % 12 else ["vile", "x", "vile"]
        out.append((i, " ".join(w), int(bad)))
    return out


def test_planted_passages(spark):
    rows = _rows(1500, 1)
    extra = [(None, None, 0), (2000, "", 0), (2001, "vile ", 0), (2001, "vile ", 0), (2002, "ban " * 60_000 + "vile x vile", 0), (2003, rows[0][1], 0)]
    docs = spark.createDataFrame([r[:2] for r in rows + extra], "doc_id long, text string").selectExpr("*", "7 AS toxic", "8 AS score", "9 AS body", "1 AS key")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    truth, texts = {i: y for i, _, y in rows}, {i: t for i, t, _ in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    for r in got:
        for p in r["passages"]:
            words = texts.get(r["doc_id"], "vile x vile ban")[p["start"] : p["end"]] if r["doc_id"] in texts else "vile"
            assert re.match("zug|vile", words)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["score"] == by[2000]["score"] < 0.5 and by[2002]["passages"] and by[2003]["score"] == by[0]["score"] > 0.5


def test_labels_that_tell_nothing(spark):
    docs = spark.createDataFrame([(str(i), f"some text {i}") for i in range(40)], "doc_id string, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.25}
    one = spark.createDataFrame([(i, 0) for i in range(40)], "doc_id long, toxic int")
    assert all(r["score"] < 0.1 and r["predicted"] == 0 for r in toxicity.score(docs, one).collect())
    assert toxicity.score(docs.limit(0), one).count() == 0


def test_held_out_labels(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = toxicity.score(docs, labels).where(F.col("held_out")).join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    rank, toxic = got["score"].rank(), got["toxic"] == 1
    n = toxic.sum()
    assert (rank[toxic].sum() - n * (n + 1) / 2) / (n * (len(got) - n)) > 0.94
    assert (got["predicted"] == got["toxic"]).mean() > 0.965
