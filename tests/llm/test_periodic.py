"""Runs of words against a brute-force definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessella.llm import periodic, queries


def _brute(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, exponent * q) and not any(all(w[k] == w[k + s] for k in range(i, i + n - s)) for s in range(1, q)):
                out.append((i, n, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_runs_by_brute_force(exponent):
    rng = random.Random(exponent)
    texts = [[], ["a"], ["a"] * 40, list("ab" * 30), list("aab" * 9 + "aab" * 4)]
    for _ in range(600):
        t = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            t += [rng.choice("abc") for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
        texts.append(t)
    for least in (1, 6):
        assert periodic.runs(texts, least, exponent) == [_brute(t, least, exponent) for t in texts]


def test_suffix_ranks_and_common_prefixes():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 3, n).tolist() for n in (0, 1, 30, 200, 7)] + [[1, 2] * 60]
    size = np.array([len(t) for t in texts])
    end, text = np.repeat(np.cumsum(size), size), np.repeat(np.arange(len(texts)), size)
    word = np.concatenate([np.array(t, np.int64) for t in texts])
    rank = periodic.suffix_ranks(word, end, text)
    whole = [(-int(text[i]), word[i : end[i]].tolist()) for i in range(len(word))]
    assert [whole[i] for i in np.argsort(rank)] == sorted(whole)
    assert periodic.next_smaller(rank).tolist() == [next((j for j in range(i + 1, len(rank)) if rank[j] < rank[i]), len(rank)) for i in range(len(rank))]
    got = periodic.CommonPrefixes(word, end, rank)
    for a, b in ((1, 5), (40, 200), (231, 230), (240, 260), (300, 302)):
        x, y = whole[a][1], whole[b][1]
        same = text[a] == text[b]
        want = next((k for k, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y))) if same else 0
        assert got.of(np.array([a]), np.array([b])).tolist() == [want]


def _by_hand(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = _brute(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *head, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_by_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a", "b", "é", "c\td", "x\x0by ", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(None, "a " * 9), (7, None), (7, None), (8, ""), (9, "  \n"), (26, "a"), (500, "la " * 3000 + "end"), (501, " ".join(f"w{i}" for i in range(700)) * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS n", "3 AS w", "4 AS h", "5 AS n_words")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((_by_hand(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 20
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_collapsed_text(spark):
    docs = spark.createDataFrame([("k", "x a b a b a b a b y"), (None, None)], "key string, body string")
    got = sorted((r["doc_id"] or "", r["n_words"], [tuple(x) for x in r["runs"]], r["text"]) for r in periodic.find_runs(docs, id_col="key", text_col="body").collect())
    assert got == [("", 0, [], ""), ("k", 10, [(1, 8, 2)], "x a b y")]
