"""Runs of a text's words, found by the runs theorem.

A run has a root that is the longest Lyndon word at its place, under some order of the words or under its reverse. The
longest Lyndon word at i ends where the inverse suffix array has its next smaller value. Each such root is extended to
both sides as far as words agree, by the longest common prefixes of suffixes: minima of the LCP array over a range,
looked up in a sparse table. Many texts are handled at once in arrays; nothing but the text's length bounds the work.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .bpe import slices

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Words that are handled at once, and more where a single text has more.
AT_ONCE = 200_000


def suffix_ranks(word: np.ndarray, end: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The inverse suffix array of texts laid end to end, by doubling; later texts rank lower, a text's end is least.

    end, text: for each place where its text ends and which it is. Only suffixes that still tie are sorted again.
    """
    n = len(word)
    key = (text.max(initial=0) - text).astype(np.int64) << 32 | word
    at = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(np.r_[True, (k := key[at])[1:] != k[:-1]])
    size = np.diff(np.r_[first, n])
    rank[at] = np.repeat(first, size)
    at = at[np.repeat(size > 1, size)]
    h = 1
    while len(at):
        after = np.where(at + h < end[at], rank[np.minimum(at + h, n - 1)] + 1, 0)
        old = rank[at]
        key = old * (n + 1) + after
        order = np.argsort(key, kind="stable")
        at, key, old = at[order], key[order], old[order]
        place = np.arange(len(at))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        group = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        begin = group[np.searchsorted(group, first, "right") - 1]
        size = np.diff(np.r_[first, len(at)])
        rank[at] = np.repeat(old[first] + place[first] - begin, size)
        at = at[np.repeat(size > 1, size)]
        h *= 2
    return rank


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one of a lower value, or the length."""
    n = len(rank)
    value = [*rank.tolist(), -1]
    out = [n] * n
    for i in range(n - 1, -1, -1):
        v, j = value[i], i + 1
        while value[j] > v:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


class CommonPrefixes:
    """Lengths that two suffixes of one text have in common."""

    def __init__(self, word: np.ndarray, end: np.ndarray, rank: np.ndarray):
        self.rank, n = rank, len(word)
        lcp = [0] * n  # at r: of the suffixes of ranks r - 1 and r (Kasai and others)
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        before = np.where(rank > 0, order[np.maximum(rank - 1, 0)], -1).tolist()
        words, ends, h = word.tolist(), end.tolist(), 0
        for i, (j, r) in enumerate(zip(before, rank.tolist(), strict=True)):
            if j < 0 or ends[j] != ends[i]:
                h = 0
                continue
            most = ends[i] - max(i, j)
            while h < most and words[i + h] == words[j + h]:
                h += 1
            lcp[r] = h
            h = max(h - 1, 0)
        self.table = [np.array(lcp, np.int64)]
        step = 1
        while 2 * step <= n:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.log2(high - low).astype(np.int64)
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level).tolist():
            m = level == k
            out[m] = np.minimum(self.table[k][low[m]], self.table[k][high[m] - (1 << k)])
        return out


def _roots(word: np.ndarray, end: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, p): longest Lyndon words of p words at i, in either order, that stand at least `least` - 1 times in a row from i on.

    A run of an exponent of `least` has such a root: its first one starts within the first period.
    """
    found = []
    for values in (word, word.max(initial=0) - word):
        after = next_smaller(suffix_ranks(values, end, text))
        i = np.arange(len(word))
        p = after - i
        ok = i + (least - 1) * p <= end
        i, p = i[ok], p[ok]
        for k in range(1, least - 1):
            ok = (word[i] == word[i + k * p]) & (after[i + k * p] == i + (k + 1) * p)
            i, p = i[ok], p[ok]
        found.append((i, p))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def runs(texts: list[list], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start, then period.

    A run is a stretch with smallest period q that no neighbour prolongs, of min_length words and min_exponent * q words at
    least; min_exponent is 2 or more.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    words: list[int] = []
    for t in texts:
        code: dict = {}
        words += [code.setdefault(w, len(code)) for w in t]
    word = np.array(words, np.int64)
    start = np.cumsum(size) - size
    end, text = np.repeat(start + size, size), np.repeat(np.arange(len(texts)), size)
    i, p = _roots(word, end, text, min_exponent)
    if not len(i):
        return out
    # Texts without such a root have no run; common prefixes are only needed in the others, forwards and backwards.
    some = np.unique(text[i])
    kept = np.isin(text, some)
    moved = np.cumsum(kept) - 1
    word, end, text, i = word[kept], moved[end[kept] - 1] + 1, text[kept], moved[i]
    n, j = len(word), i + p
    first = end - size[text]
    ahead, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    inner, within = i > first[i], j < end[i]
    ahead[within] = CommonPrefixes(word, end, suffix_ranks(word, end, text)).of(i[within], j[within])
    flipped, flipped_end, flipped_text = word[::-1].copy(), n - first[::-1], text.max() - text[::-1]
    behind = CommonPrefixes(flipped, flipped_end, suffix_ranks(flipped, flipped_end, flipped_text))
    back[inner] = behind.of(n - i[inner], n - j[inner])
    length = p + ahead + back
    ok = length >= np.maximum(min_length, min_exponent * p)
    rows = np.unique(np.column_stack([text[i], i - back - first[i], p, length])[ok], axis=0)
    for t, a, q, m in rows.tolist():
        out[t].append((a, m, q))
    return out


def collapse(words: list, found: Iterable[tuple[int, int, int]]) -> list:
    """words without those that stand in a run after its first period."""
    gone = np.zeros(len(words), bool)
    for start, length, period in found:
        gone[start + period : start + length] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words), text (words outside repetitions, joined by blanks) of every row.

    Words are runs of characters other than blanks and U+0009 to U+000D, numbered from 0. A null text is an empty one,
    without runs; repeated rows and null ids stay; an empty table gives no rows. No row moves between tasks.
    """
    common.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names, fields = ["doc_id", "n_words", "runs", "text"], f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string"
    spans = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def done(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs(texts, min_length, min_exponent)
        left = [b" ".join(collapse(t, f) if f else t).decode("utf-8", "surrogatepass") for t, f in zip(texts, found, strict=True)]
        each = [[{"start": a, "length": m, "period": q} for a, m, q in f] for f in found]
        return pa.record_batch([ids, pa.array(list(map(len, texts)), pa.int64()), pa.array(each, spans), pa.array(left, pa.string())], names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            ids, begin, n = batch.column(0), 0, 0
            texts: list[list[bytes]] = []
            for k, t in enumerate(batch.column(1).to_pylist()):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                if texts and n + len(words) > AT_ONCE:
                    yield done(ids.slice(begin, len(texts)), texts)
                    texts, begin, n = [], k, 0
                texts.append(words)
                n += len(words)
            if texts:
                yield done(ids.slice(begin, len(texts)), texts)

    return docs.select(id_col, text_col).mapInArrow(run, fields)
