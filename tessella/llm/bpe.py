"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list.

The vocabulary file is JSON as the tokenizers library reads it: NFC, lower case, split into words,
bytes as printable characters, merges inside a word whose last symbol carries a word-end suffix.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from . import common

WORD_BPE = "word_bpe_49k.json"
#: Entries in each of the two generations of the memo of chunks; longer chunks are not kept.
MEMO_SIZE, MEMO_CHARS = 250_000, 64
SHIFT = 20
_LOW = (1 << SHIFT) - 1


def byte_alphabet() -> list[str]:
    """A printable character for each byte: Latin-1's printable ones stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], n = chr(256 + n), n + 1
    return out


def merge(symbols: list[int], table: dict[int, int]) -> list[int]:
    """Merges neighbours by rank, leftmost first among equals.

    table: left << SHIFT | right -> rank << SHIFT | merged. The queue holds that value and the place, as one number;
    an entry whose place has meanwhile merged into something else is stale and skipped.
    """
    n = len(symbols)
    get = table.get
    queue = [hit << 32 | i for i, hit in enumerate(map(get, [a << SHIFT | b for a, b in pairwise(symbols)])) if hit is not None]
    if not queue:
        return symbols
    heapify(queue)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while queue:
        entry = heappop(queue)
        i, hit = entry & 0xFFFFFFFF, entry >> 32
        left, j = symbols[i], after[i]
        if left < 0 or j >= n or get(left << SHIFT | symbols[j]) != hit:
            continue
        symbols[i] = merged = hit & _LOW
        symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            hit = get(merged << SHIFT | symbols[k])
            if hit is not None:
                heappush(queue, hit << 32 | i)
        p = before[i]
        if p >= 0:
            hit = get(symbols[p] << SHIFT | merged)
            if hit is not None:
                heappush(queue, hit << 32 | p)
    return [s for s in symbols if s >= 0]


class Memo(dict):
    """A bounded memo: two generations, the older one goes when the newer is full."""

    def __init__(self, make, size: int = MEMO_SIZE, longest: int = MEMO_CHARS):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordBpe:
    """encode() and decode() of one vocabulary file."""

    #: Blanks for str.split() that are none for the library; characters beyond those that all versions of Unicode agree on.
    _odd, _new = re.compile("[\x1c-\x1f]"), re.compile("[^\x00-\u017f]")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_alphabet()
        self._table = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key = vocab[a] << SHIFT | vocab[b]
            whole = a + b
            self._table.setdefault(key, rank << SHIFT | vocab[whole])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"])
        self._spaced = regex.compile(r"[^ \t\n\v\f\r]+")
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        # Which characters are letters, what composes and what is lower case differs between versions of Unicode:
        # beyond U+017F, up to where all have agreed ever since, the library's own normaliser and splitter say it.
        library = Tokenizer.from_file(path)
        self._normalise, self._cut, self._model = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str, library.model
        self._letters, self._bytes = dict(enumerate(letters)), {c: b for b, c in enumerate(letters)}
        self._inner = [vocab[c] for c in letters]
        self._last = [vocab[c + suffix] for c in letters]
        self._memo = Memo(self._chunk)

    def _word(self, raw: bytes) -> bytes:
        symbols = [self._inner[b] for b in raw]
        symbols[-1] = self._last[raw[-1]]
        return array("I", merge(symbols, self._table) if len(symbols) > 1 else symbols).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """The ids of text without ASCII's blanks. Letters alone are one word; most other chunks end in one mark."""
        if self._new.search(chunk):
            cut = self._cut(self._normalise(chunk))
            return b"".join([self._word(bytes([self._bytes[c] for c in w])) for w, _ in cut])
        chunk = chunk.lower()
        if chunk.isalpha():
            return self._word(chunk.encode("utf-8"))
        if chunk[:-1].isalpha() and not chunk[-1].isalnum():
            return self._memo[chunk[:-1]] + self._memo[chunk[-1]]
        words = self._words.findall(chunk)
        return b"".join([self._memo[w] for w in words]) if len(words) != 1 else self._word(words[0].encode("utf-8"))

    def _plain(self, text: str) -> bytes:
        if not self._new.search(text):
            text = text.lower()
        chunks = self._spaced.findall(text) if self._odd.search(text) else text.split()
        return b"".join(map(self._memo.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not self._special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings, joined by the blank that the library puts where a file names no decoder."""
        numbers = array("I")
        numbers.frombytes(ids)
        return " ".join(map(self.strings.__getitem__, numbers))


class LibraryWordBpe(WordBpe):
    """The same, with the library's own merges of a word: for operators that take ids as given."""

    def _word(self, raw: bytes) -> bytes:
        return array("I", [t.id for t in self._model.tokenize(raw.decode("latin-1").translate(self._letters))]).tobytes()


_loaded: dict[tuple[str, type], WordBpe] = {}


def load(path: str, kind: type[WordBpe] = WordBpe) -> WordBpe:
    """One per worker process, file and kind."""
    if (path, kind) not in _loaded:
        _loaded[path, kind] = kind(path)
    return _loaded[path, kind]


def slices(batches: Iterable[pa.RecordBatch], nbytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about nbytes, so that long texts don't add up in memory."""
    for batch in batches:
        step = max(1, int(batch.num_rows * nbytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (text) of every row; null text: empty, no ids. Keeps repeated rows and null ids."""
    path = path or common.tokenizer_file(WORD_BPE)
    common.ship(docs.sparkSession)

    def run(batches):
        bpe = load(path)
        for batch in slices(batches):
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            lists = []
            for x in ids:
                a = array("i")
                a.frombytes(x)
                lists.append(a)
            offsets = pa.array([0, *_ends(ids)], pa.int32())
            flat = pa.py_buffer(b"".join(ids))
            values = pa.Array.from_buffers(pa.int32(), sum(map(len, lists)), [None, flat])
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, values), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def _ends(ids: list[bytes]) -> Iterator[int]:
    n = 0
    for x in ids:
        n += len(x) // 4
        yield n


def round_trip_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode_decode() gives, as digests, so that no ids leave the worker."""
    path = path or common.tokenizer_file(WORD_BPE)
    common.ship(docs.sparkSession)

    def run(batches):
        bpe = load(path)
        for batch in slices(batches):
            n, a, b = [], [], []
            for t in batch.column(1).to_pylist():
                ids = bpe.encode(t or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
