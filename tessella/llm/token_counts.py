"""Token counts by rank-synchronous merging of ragged arrays.

The model is a sentencepiece BPE file with identity normalisation, a blank put first, byte fallback.
A piece has blanks at its start only, and line feeds in none, so no merge crosses the start of a run
of blanks or a line feed: text splits there into pre-tokens that are merged independently.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .bpe import Memo, merge, slices

PIECE_BPE = "piece_bpe_32k.model"
BLANK = "▁"
#: Longer pre-tokens go through the priority queue of bpe.merge(): one merge a round would cost length squared.
LONGEST = 200
MEMO_SIZE = 150_000


class PieceCounter:
    """count() of many texts under one model file."""

    _pre = re.compile(r" *[^ \n]+| +|\n")

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ids = {model.id_to_piece(i): i for i in plain}
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in ids):
            raise ValueError("pieces hold a blank after another character: pre-tokens can't be merged alone")
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        # Characters that only occur inside pieces get ids after those of the vocabulary.
        for c in sorted({c for p in ids for c in p}):
            ids.setdefault(c, n + len(ids))
        top = max(ids.values()) + 1
        self._weight = np.ones(top + 5, np.int64)
        for c, i in ids.items():
            if i >= n:
                self._weight[i] = len(c.encode("utf-8"))
        self._weight[top + 1 :] = range(1, 5)
        self._of_char = np.empty(0x110000, np.int32)
        for end, size in ((0x110000, 4), (0x10000, 3), (0x800, 2), (0x80, 1)):
            self._of_char[:end] = top + size
        for p, i in ids.items():
            if len(p) == 1:
                self._of_char[ord(p)] = i
        self._of_char[ord(" ")] = self._of_char[ord(BLANK)]
        pairs = {}
        for i in plain:
            p = model.id_to_piece(i)
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank[model.get_score(i)] << 20 | i
        self._pairs = pairs
        self._keys = np.array(sorted(pairs), np.int64)
        found = np.array([pairs[k] for k in self._keys.tolist()], np.int64)
        self._rank, self._merged = found >> 20, (found & 0xFFFFF).astype(np.int32)
        self._none = len(scores)
        self._seen: Memo = Memo(None, MEMO_SIZE, 64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        hit = self._keys[at] == key
        return np.where(hit, self._rank[at], self._none), self._merged[at]

    def _symbols(self, text: str) -> np.ndarray:
        return self._of_char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def merged_counts(self, tokens: list[str]) -> list[int]:
        """Tokens in each non-empty pre-token: every round merges, in all sequences at once, each one's leftmost pair of lowest rank."""
        if not tokens:
            return []
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        counts = np.zeros(len(tokens), np.int64)
        long = np.flatnonzero(sizes > LONGEST)
        for k in long.tolist():
            counts[k] = self._weight[merge(self._symbols(tokens[k]).tolist(), self._pairs)].sum()
        who = np.flatnonzero(sizes <= LONGEST)
        if not len(who):
            return counts.tolist()
        sym = self._symbols("".join([tokens[k] for k in who.tolist()]) if len(long) else "".join(tokens))
        owner = np.repeat(who, sizes[who])
        pair, into = self._pair_up(sym, owner)
        while len(sym):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(pair, start)
            length = np.diff(np.r_[start, len(sym)])
            still = least < self._none
            if not still.all():  # what merges no further is counted and leaves
                done = ~np.repeat(still, length)
                counts += np.bincount(owner[done], self._weight[sym[done]], len(counts)).astype(np.int64)
                sym, owner, pair, into = (x[~done] for x in (sym, owner, pair, into))
                least, length = least[still], length[still]
                if not len(sym):
                    break
            at = np.flatnonzero(pair == np.repeat(least, length))
            at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one symbol of each earlier sequence has gone
            sym, owner, pair, into = (x[keep] for x in (sym, owner, pair, into))
            for place in (at, at[at > 0] - 1):
                place = place[place + 1 < len(sym)] if len(place) else place
                inside = owner[place] == owner[place + 1]
                r, m = self._lookup(sym[place], sym[place + 1])
                pair[place], into[place] = np.where(inside, r, self._none), m
            if len(at) and at[-1] == len(sym) - 1:
                pair[-1] = self._none
        return counts.tolist()

    def _pair_up(self, sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = np.full(len(sym), self._none, np.int64)
        into = np.zeros(len(sym), np.int32)
        r, m = self._lookup(sym[:-1], sym[1:])
        pair[:-1] = np.where(owner[1:] == owner[:-1], r, self._none)
        into[:-1] = m
        return pair, into

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; none for an empty one."""
        split = self._pre.findall
        cut = [split(" " + t.replace(BLANK, " ")) if t else [] for t in texts]
        seen = self._seen
        new: dict[str, int] = {}
        for words in cut:
            for w in words:
                if w not in seen and w not in new:
                    new[w] = seen.old.get(w, -1)
        missing = [w for w, v in new.items() if v < 0]
        new.update(zip(missing, self.merged_counts(missing), strict=True))
        out = []
        for words in cut:
            n = 0
            for w in words:
                n += seen[w] if w in seen else new[w]
            out.append(n)
        for w, v in new.items():
            if len(w) <= seen.longest:
                if len(seen) >= seen.size:
                    seen.old = dict(seen)
                    seen.clear()
                seen[w] = v
        return out


_loaded: dict[str, PieceCounter] = {}


def load(path: str) -> PieceCounter:
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; null text: empty, no tokens. Keeps repeated rows and null ids."""
    path = path or common.tokenizer_file(PIECE_BPE)
    common.ship(docs.sparkSession)

    def run(batches):
        counter = load(path)
        for batch in slices(batches, 4 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = counter.count(texts)
            size = [len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
