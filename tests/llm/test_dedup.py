"""Sharding, exact and near duplicates, boilerplate lines against brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tessella.llm import common, components, digest_index, line_dedup, sharding, simhash


def _jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(0, 2**64, 3000, dtype=np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [_jump(int(k), n) for k in keys]
    a, b = sharding.jump_hash(keys, 24), sharding.jump_hash(keys, 25)
    assert set(b[a != b].tolist()) <= {24} and 0.01 < (a != b).mean() < 0.08


def test_shards_over_rows(spark):
    rows = [(i, f"text {i % 7}") for i in range(500)] + [(3, "text 3"), (None, None), (None, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "body").selectExpr("doc_id", "body AS text", "1 AS shard", "2 AS slot", "3 AS row")
    got = sharding.shard(docs, 24).collect()
    assert len(got) == len(rows)
    slots, of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        of[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in of.values())
    one = next(r for r in got if r["size"] == 10)
    assert one["text_crc32"] == zlib.crc32("é".encode())
    assert sharding.shard(docs.limit(0)).count() == 0


def test_exact_duplicates(spark):
    rows = [(5, "a b\nc"), (3, "abc"), (9, "ab  c"), (9, "ab  c"), (1, None), (2, ""), (7, " \t"), (8, "abd"), (None, "ab  c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS digest", "1 AS row", "2 AS keep_id")
    index = digest_index.DigestIndex(spark, common.scratch_path(spark, "index"), 4)
    got = sorted(((r["doc_id"] or -1), r["keep_id"], r["group_size"], r["kept"]) for r in digest_index.deduplicate(docs, index).collect())
    assert [g[:3] for g in got] == [(-1, 5, 5), (1, 7, 3), (2, 7, 3), (3, 5, 5), (5, 5, 5), (7, 7, 3), (8, 8, 1), (9, 5, 5), (9, 5, 5)]
    assert [g[0] for g in got if g[3]] == [5, 7, 8]
    again = digest_index.deduplicate(docs, index).collect()
    assert not any(r["kept"] for r in again) and {r["keep_id"] for r in again} == {5, 7, 8}
    more = digest_index.deduplicate(spark.createDataFrame([(50, "a  bc"), (51, "new")], "doc_id long, text string"), index).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in more) == [(50, 5, False), (51, 51, True)]
    index.close()
    kept = digest_index.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [5, 7, 8]
    twice = spark.createDataFrame([(1, "same"), (1, "same")], "doc_id long, text string")
    assert digest_index.keep_first(twice).count() == 1
    empty = digest_index.DigestIndex(spark, common.scratch_path(spark, "index"), 4)
    assert digest_index.deduplicate(docs.limit(0), empty).count() == 0


def test_exact_duplicates_of_hot_and_other_groups(spark):
    rng = random.Random(9)
    texts = [f"t{i}" for i in range(1500)] + ["hot one"] * 700 + [rng.choice(["ho t one", "hotone", "t7 ", " t8", None, "\t"]) for _ in range(300)]
    rng.shuffle(texts)
    index = digest_index.DigestIndex(spark, common.scratch_path(spark, "index"), 4)
    got = digest_index.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), index)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan  # one task never holds the copies of a hot text
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), i == min(g)[1]) for g in groups.values() for _, i in g}
    rows = got.collect()
    assert len(rows) == len(texts) and {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows} == want
    assert not any(r["kept"] for r in digest_index.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), index).collect())
    index.close()


def test_exact_duplicates_survive_a_lost_result(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "xy"), (None, "xy"), ("c", "z" * 300_000)], "doc_id string, text string")
    path = common.scratch_path(spark, "index")
    index = digest_index.DigestIndex(spark, path, 3, "string")
    digest_index.deduplicate(docs, index, batch="monday")  # never read
    index.close()
    index = digest_index.DigestIndex(spark, path)  # opened again: its own buckets and ids
    assert (index.buckets, index.id_type) == (3, "string")
    got = digest_index.deduplicate(docs, index, batch="monday")
    assert sorted((r["doc_id"] or "", r["keep_id"], r["kept"]) for r in got.collect()) == [("", "b", False), ("a", "b", False), ("b", "b", True), ("c", "c", True)]
    assert not any(r["kept"] for r in digest_index.deduplicate(docs, index, batch="tuesday").collect())
    groups = spark.createDataFrame([(b"x", 1)], "digest binary, n int")
    for plan in (index.known(groups), index.absent(groups)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in text  # that of groups
    index.close()
    far = spark.createDataFrame([(-(2**63), "a"), (5, "a")], "doc_id long, text string")
    assert [r["doc_id"] for r in digest_index.keep_first(far).collect()] == [-(2**63)]
    assert digest_index.keep_first(docs.selectExpr("*", "1 AS tess_digest", "2 AS n")).count() == 2


def test_fingerprint_by_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(["A", "bé ", "c d ", " ", "\n", "Éx "]) for _ in range(rng.randint(0, 30)))
        w = [x for x in t.encode().lower().split()]
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        assert simhash.fingerprint(t) == want


def _components(n, edges):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(0)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]):
        want = _components(61, edges)
        got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        touched = {x for e in edges if e[0] != e[1] for x in e}
        assert set(got) == touched
        groups = defaultdict(set)
        for k, v in got.items():
            groups[v].add(k)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i in touched if want[i] == r) for r in {want[i] for i in touched})


def test_links_by_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {rng.getrandbits(64) for _ in range(100)} | {0, 2**64 - 1}
    for b in base:
        for _ in range(60):  # crowded blocks: many fingerprints about one
            x = b
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    want = _components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    at = {s: i for i, s in enumerate(signed)}
    for crowd in (2, 16, 10_000):
        got = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 2, crowd).collect()
        assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 4 for r in got)
        assert _components(len(fps), [(at[r["a"]], at[r["b"]]) for r in got]) == want


def test_near_duplicates_over_rows(spark):
    rows = [(4, "one two three four"), (2, "one two three four"), (9, None), (7, ""), (8, "other words here now"), (None, "other words here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(4, 2), (2, 2), (9, 7), (7, 7), (8, 8), (None, 8)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [2000, 0])
def test_boilerplate_lines(spark, monkeypatch, sent):
    monkeypatch.setattr(line_dedup, "SENT_LINES", sent)  # 0: lines are joined
    rows = [(i, f"s{i % 12}", f"own line {i}\n  shared by all \n\nshared by {i % 2}\n{'rare' if i % 12 < 3 else 'x' + str(i)}") for i in range(60)]
    rows += [(100, None, None), (101, "s1", ""), (101, "s1", "shared by all\nmine"), (None, "s2", "mine two\nshared by all"), (102, "s3", "long " * 40_000 + "\nshared by all")]
    rows += [(200 + i, f"s{i % 12}", "copied line one\ncopied line two") for i in range(30)]  # copies spread like other lines
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS lines", "2 AS gone", "3 AS site", "4 AS line", "5 AS l", "6 AS row")
    sites = defaultdict(set)
    for _, s, t in rows:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                sites[x.strip(" ")].add(s or "")
    for least in (3, 6, 8, 12):
        bad = {x for x, v in sites.items() if len(v) >= least}
        want = sorted(((i if i is not None else -1), "\n".join(x for x in (t or "").split("\n") if x.strip(" ") not in bad)) for i, _, t in rows)
        got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["text"]) for r in line_dedup.remove_boilerplate(docs, least).collect())
        assert got == want, least
    assert line_dedup.remove_boilerplate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("part", [100, 2_000_000])
def test_similar_groups_by_brute_force(spark, monkeypatch, part):
    rng = random.Random(8)
    vocab = [f"{a}{b}{c}" for a in "bdfglm" for b in ("ano", "ire", "ulo") for c in ("st", "r", "nd", "ck", "pel")]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocab) + str(rng.randrange(400)) for _ in range(rng.randint(80, 300))]
        texts.append(" ".join(base))
        for _ in range(3):
            t = list(base)
            for _ in range(rng.choice((1, 2, 40))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (901, "")], "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS row", "3 AS keys")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(texts)) for j in range(max(0, i - 3), i)}
    monkeypatch.setattr(simhash, "PART_SHINGLES", part)  # 100: groups of few texts are heavy
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    links = [p for p, j in alike.items() if j >= 0.8]
    assert sum(got.get(i, i) == got.get(j, j) for i, j in links) >= 0.99 * len(links)
    exact = _components(len(texts), links)
    assert all(exact[i] == exact[j] for i, j in got.items())  # nothing is linked that isn't alike
    kept = simhash.keep_one_similar(docs)
    assert kept.columns == docs.columns and kept.where("doc_id >= 900").count() == 3
    assert simhash.similar_groups(docs.limit(0)).count() == 0


def test_crowded_blocks_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**64, (600, simhash.WIDE), dtype=np.uint64)
    bits = simhash.most_bits(0.8)
    for i in range(0, 120, 3):  # i + 1 is alike i, i + 2 only alike i + 1
        for j in (i + 1, i + 2):
            flips = np.zeros(simhash.WIDE * 64, np.uint8)
            flips[rng.choice(len(flips), bits - 10, replace=False)] = 1
            fps[j] = fps[j - 1] ^ np.packbits(flips).view(np.uint64)
    fps[200:400] = fps[200]  # a group of copies
    fps[400:500, 0] = fps[200, 0] ^ np.arange(100, dtype=np.uint64)
    fps[400:500, 1:] = fps[200, 1:]
    want = _components(600, [(i, j) for i in range(600) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]).sum() <= bits])
    keys = [[7, i if i % 2 else 9] for i in range(600)]  # all in one block, half of them in a second one
    rows = spark.createDataFrame([(i, [int(x) for x in f.view(np.int64)], k) for i, (f, k) in enumerate(zip(fps, keys, strict=True))], "row long, fp array<long>, keys array<int>")
    for part in (70, 4096):
        got = [(r["a"], r["b"]) for r in simhash.similar_pairs(rows, bits, 16, part).collect()]
        assert all(np.bitwise_count(fps[a] ^ fps[b]).sum() <= bits for a, b in got)
        assert _components(600, got) == want
        assert len(got) < 600 * 40


def test_forest_in_a_metric():
    rng = np.random.default_rng(6)
    for n in (1, 2, 60):
        sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30))) for _ in range(n)]
        far = lambda which, one: simhash.apart([sets[i] for i in which], sets[one])
        want = _components(n, [(i, j) for i in range(n) for j in range(i) if far([i], j)[0] <= 0.6])
        assert _components(n, simhash.forest(far, n, 0.6)) == want
        known = np.array([0, *[i for i in range(1, n) if want[i] == want[0]]])
        got = _components(n, simhash.forest(far, n, 0.6, known) + [(0, int(i)) for i in known[1:]])
        assert got == want
