"""Many phrases in one pass against a pattern for each."""

import random
import re

from tessella.operators import documents as doc


def test_phrases_as_patterns(spark):
    rng = random.Random(6)
    words = ["the", "The", "of", "in", "a", "ü", "x_1", "C++", "e-mail", "can't", "日本", *[a + b for a in "bdk" for b in ("an", "ot", "ill")]]
    phrases = {" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(4000)}
    phrases = sorted(phrases)[:2000] + ["a a", "the", "the of the"]
    rules = [{"id": f"t{i}", "kind": "TERMINOLOGY", "avoid": p} for i, p in enumerate(phrases)]
    rules += [{"id": "cap", "kind": "CAPITALIZATION", "term": "Ban"}, {"id": "cap2", "kind": "CAPITALIZATION", "term": "ban"}, {"id": "pat", "kind": "PATTERN", "pattern": r"[a-z]+ü"}, {"id": "bad", "kind": "PATTERN", "pattern": "("}]
    texts = [None, "", "a a a a a", "😀 the", "thethe the_of of the of the"] + ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ".", "\n", ""]) for _ in range(rng.randint(1, 25))) for _ in range(80)]
    texts += ["x" * 2_000 + " the of " + "a " * 5, " ".join(w.upper() for w in words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, body string").selectExpr("*", "'r' AS rule", "1 AS start", "2 AS match")
    got = sorted(tuple(r) for r in doc.house_rules(docs, "id", "body", rules).collect())

    def of(r):
        if r["kind"] == "PATTERN":
            return re.compile(r["pattern"], re.A) if r["id"] != "bad" else None
        return re.compile(rf"\b(?i:{re.escape(r.get('avoid') or r['term'])})\b", re.A)

    want = []
    for r in rules:
        p = of(r)
        for i, t in enumerate(texts):
            for m in p.finditer(t or "") if p else ():
                if r["kind"] != "CAPITALIZATION" or m[0] != r["term"]:
                    want.append((i, r["id"], m.start(), m.end(), m[0]))
    assert got == sorted(want)
    assert len({g[1] for g in got}) > 200
    assert doc.house_rules(docs.limit(0), "id", "body", rules).count() == 0


def test_same_offsets_as_apply_rules(spark):
    docs = spark.createDataFrame([(1, "In the end the End, end-of the_end THE END"), (2, "end" * 50_000 + " the end")], "id int, body string")
    rules = [("a", "the end"), ("b", "end"), ("c", "of")]
    phrases = doc.phrase_rules(docs, "id", "body", [(i, p, False) for i, p in rules])
    patterns = doc.apply_rules(docs, "id", "body", [(i, rf"(?i)\b{p}\b") for i, p in rules])
    assert sorted(map(tuple, phrases.collect())) == sorted(map(tuple, patterns.collect()))
