"""Encoding and counting against the public libraries; packing against its own laws."""

import bisect
import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest

from tessella.llm import bpe, common, packing, token_counts

WORD, PIECE = common.tokenizer_file(bpe.WORD_BPE), common.tokenizer_file(token_counts.PIECE_BPE)
ODD = ["", " ", "  ", "\n", "a", "x" * 3000, " " * 700 + "q", "ab" * 900, "Hello  World's!!'s don't", "Σς ΟΔΟΣ İ ﬁ", "a\x1cb\x85c\xa0d​e", "x<|endoftext|>Y <|STARTOFTEXT|>", "123 ½ ²", "▁▁▁a", "<s>a</s><0x41>", "🙂👍🏽 中文"]


def _texts(n):
    rng = random.Random(5)
    pool = list("abcXYZ  \n\t'sSLl.!?ΣσςİıßéÀ½²٣中文ﬁ̧́\x00\x1c\x85　▁​🙂<|>") + ["<|endoftext|>", "   ", "'ll"]
    return ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("kind", [bpe.WordBpe, bpe.LibraryWordBpe])
def test_encode_and_decode_as_the_library(kind):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(WORD), bpe.load(WORD, kind)
    for t in _texts(3000):
        want = lib.encode(t, add_special_tokens=False)
        got = own.encode(t)
        assert got == array("I", want.ids).tobytes(), t
        assert own.decode(got) == lib.decode(want.ids, skip_special_tokens=False)


@pytest.mark.parametrize("kind", [bpe.WordBpe, bpe.LibraryWordBpe])
def test_every_code_point_as_the_library(kind):
    from tokenizers import Tokenizer

    lib, own, rng = Tokenizer.from_file(WORD), bpe.load(WORD, kind), random.Random(9)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x40000 or c >= 0xE0000)]
    texts = [f"a{c}b{c}" for c in points]
    texts += ["".join(points[rng.randrange(rng.choice((0x180, 0x800, 0x20000, len(points))))] for _ in range(rng.randint(0, 30))) for _ in range(10_000)]
    wrong = [t for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True) if own.encode(t) != array("I", e.ids).tobytes()]
    assert not wrong


def test_counts_as_the_library():
    import sentencepiece

    texts = _texts(3000)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert token_counts.load(PIECE).count(texts) == [len(x) for x in lib.encode(texts)]


def test_memo_is_bounded():
    memo = bpe.Memo(len, size=10)
    assert [memo["x" * i] for i in range(50)] == list(range(50))
    assert len(memo) <= 10 and len(memo.old) <= 10


def test_round_trip_over_rows(spark):
    rows = [(1, "Hello world", 5, "n"), (1, "Hello world", 5, "n"), (2, None, 6, "m"), (None, "", 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, decoded string")
    got = bpe.round_trip_digests(docs).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in got) == [(False, 1, 2), (False, 1, 2), (False, 2, 0), (True, 0, 0)]
    assert all(r[2] == r[3] == empty for r in got if r[1] == 0)
    full = {r["doc_id"]: r for r in bpe.encode_decode(docs).collect()}
    assert full[1]["decoded"] == "hello</w> world</w>" and len(full[1]["ids"]) == 2 and full[2]["ids"] == []
    assert bpe.encode_decode(docs.limit(0)).count() == 0


def test_token_counts_over_rows(spark):
    docs = spark.createDataFrame([(1, "é b"), (2, None), (2, None), (3, "a " * 5000)], "doc_id long, text string")
    got = sorted(tuple(r) for r in token_counts.token_counts(docs).collect())
    assert got[0][:2] == (1, 4) and got[1] == got[2] == (2, 0, 0, False) and got[3][3] is True
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def _best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, s)
        bisect.insort(gaps, (gaps.pop(i) if i < len(gaps) else capacity) - s)
    return len(gaps)


@pytest.mark.parametrize("one_task", [30_000, 0])
def test_places_fill_as_few_sequences_as_one_by_one(spark, monkeypatch, one_task):
    monkeypatch.setattr(packing, "ONE_TASK", one_task)  # 0: every round is swept by many tasks
    rng = np.random.default_rng(0)
    for capacity, sizes in ((7, rng.integers(1, 8, 300)), (2048, np.clip(rng.lognormal(np.log(340), 1, 900).astype(int), 1, 2048)), (64, np.r_[np.full(200, 20), rng.integers(1, 65, 200)])):
        rows = spark.createDataFrame([(i, int(x)) for i, x in enumerate(sizes)], "row long, size long").repartition(4)
        got = packing.place(rows, capacity).collect()
        assert sorted((r["row"], r["size"]) for r in got) == [(i, int(x)) for i, x in enumerate(sizes)]
        fill = {}
        for r in got:
            fill[r["seq"]] = fill.get(r["seq"], 0) + r["size"]
        assert max(fill.values()) <= capacity
        assert len(fill) <= _best_fit_decreasing(sizes.tolist(), capacity) * 1.03 + 1
    assert packing.place(rows.limit(0), 8).count() == 0


def test_matches_are_successors(spark):
    rng = np.random.default_rng(1)
    for n in (1, 40, 400):
        gaps, sizes = rng.integers(1, 30, n).tolist(), rng.integers(1, 30, 2 * n).tolist()
        slots = spark.createDataFrame([*enumerate(gaps)], "seq long, size long")
        pieces = spark.createDataFrame([*enumerate(sizes)], "row long, size long")
        free, want, waiting = [], [], sorted(gaps)
        for s in sorted(sizes, reverse=True):
            while waiting and waiting[-1] >= s:
                bisect.insort(free, waiting.pop())
            i = bisect.bisect_left(free, s)
            want.append((s, i < len(free)))
            if i < len(free):
                bisect.insort(free, free.pop(i) - s)
        for one in (False, True):
            got = packing.match(slots, pieces, one).collect()
            assert sorted((r["row"], r["size"]) for r in got) == [*enumerate(sizes)]
            put = {}
            for r in got:
                put.setdefault(r["seq"], []).append(r["size"])
            left = put.pop(None, [])
            assert all(sum(v) <= gaps[k] for k, v in put.items())
            untouched = [g for k, g in enumerate(gaps) if k not in put]
            assert not left or max(untouched, default=0) < min(left)
            if one:
                assert sorted((r["size"], r["seq"] is not None) for r in got) == sorted(want)


def test_pack_over_rows(spark):
    text = " ".join(f"word{i}" for i in range(900))
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x"), (5, text)], "doc_id long, text string")
    rows = packing.pack(docs, capacity=64).collect()
    own = bpe.load(WORD)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] == 5:
            ids = own.encode(text) + b"\0\0\0\0"
            assert zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
    for parts in by.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 64
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == len(own.encode(text)) // 4 + 1
    assert sorted(r["length"] for r in rows if r["doc_id"] in (2, 3)) == [1, 1]
    assert packing.pack(docs.limit(0)).count() == 0
