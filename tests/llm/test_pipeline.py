"""The pipeline's stages one by one against plain Python, and the entry's queries."""

import bisect
import re
import zlib
from collections import Counter

import __spark_entry__
from tessella.llm import bpe, common


def _one_of_each(texts):
    """The smallest id of each component of texts whose sets of five-word shingles are alike by 0.8."""
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    up, by = {i: i for i in texts}, {}
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in by.get(s, ()))
        for j, n in shared.items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                a, b = i, j
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                up[max(a, b)] = min(a, b)
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    return {i for i in texts if up[i] == i}


def test_stages_on_odd_rows(spark, sf):
    import corpus_pipeline

    text = " ".join(f"word{k} of" for k in range(60))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, text + " more", "en", None, 1), (4, "long " * 50_000, "en", "s", 9)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        assert stage(spark, docs.limit(0), sf).count() == 0
        assert name == "packed" or got.columns == docs.columns
        want = {"quality": (2, 3), "exact": (4, 4), "near": (5, 6), "personal": (6, 6)}.get(name)
        assert want is None or want[0] <= got.count() <= want[1], name
    assert {r["doc_id"] for r in got.collect()} == {1, 2, 3, 4, None}


def test_stages_take_effect(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, sf), name)
        seen[name] = docs
        assert name == "packed" or docs.columns == columns
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r["doc_id"]: r["text"] for r in seen["quality"].collect()}
    assert set(good) <= set(start) and all(len(t.split()) >= 50 for t in good.values())
    squeezed = {}
    for i in sorted(good, key=lambda i: (-len(good[i]), i)):
        squeezed.setdefault(re.sub(r"[\x20\x09-\x0D]", "", good[i]), i)
    assert {r["doc_id"] for r in seen["exact"].collect()} == set(squeezed.values())
    near = {r["doc_id"] for r in seen["near"].collect()}
    assert near == _one_of_each({i: good[i] for i in squeezed.values()})
    clean = {r["doc_id"]: r["text"] for r in seen["personal"].collect()}
    assert set(clean) == near
    for i, text in clean.items():
        # Names of kinds in brackets take the place of spans; what is left between them stands in the text in that order.
        parts = re.split(r"\[(?:EMAIL|IP|CARD|PHONE|OTHER)\]", text)
        assert re.fullmatch(".+?".join(map(re.escape, parts)), good[i], re.S)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)
    packed = seen["packed"].collect()
    own, fill = bpe.load(common.tokenizer_file(bpe.WORD_BPE)), {}
    for r in packed:
        ids = own.encode(clean[r["doc_id"]]) + bytes(4)
        part = ids[4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert r["start"] == 2048 * r["piece"] and len(part) == 4 * r["length"] and zlib.crc32(part) == r["ids_crc32"]
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted((r["doc_id"], r["piece"]) for r in packed) == sorted((i, k) for i in near for k in range(-(-(len(own.encode(clean[i])) // 4 + 1) // 2048)))
    gaps: list[int] = []
    for n in sorted((r["length"] for r in packed), reverse=True):  # best-fit decreasing, one piece at a time
        k = bisect.bisect_left(gaps, n)
        bisect.insort(gaps, (gaps.pop(k) if k < len(gaps) else 2048) - n)
    assert len(fill) <= len(gaps) * 1.02 + 1
    for parts in fill.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    run = corpus_pipeline.run(spark, sf)
    assert run.count() == len(packed)


def test_ten_operators_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
