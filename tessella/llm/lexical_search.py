"""Ranked lexical search: MaxScore in each shard of an inverted index, merged exactly.

A first pass keeps of every document what it shares with the items' terms and is written as a table, from which the
corpus counts come. Each task then lays its documents out as postings, shard after shard, and answers every item on it:
terms whose upper bounds together can't reach the k-th best score so far are not essential; only documents of the other
lists are candidates, and the rest is looked up for them, from the highest bound down, while they can still qualify.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .bpe import slices

#: Postings of a shard, about; documents scored at a time, at first and at most; items that one pass over the documents answers.
SHARD_POSTINGS, FIRST_BLOCK, LAST_BLOCK, ITEMS = 2_000_000, 256, 1 << 16, 2_000
#: ASCII letters in lower case and digits stay, other ASCII parts words; bytes of further characters belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. Null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    """The weight of a term in thousandths."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Postings of some documents: for each term the documents, in order, and what it adds to their scores."""

    def __init__(self, n: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_all: int):
        """n: terms of each document; term, doc, tf: postings by document."""
        self.size = len(n)
        m = 10 + (90 * n * n_docs) // n_all
        order = np.argsort(term, kind="stable")
        term, self.doc, tf = term[order], doc[order], tf[order]
        self.adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))
        self.first = np.searchsorted(term, np.arange(len(weights) + 1))
        self.bound = np.zeros(len(weights), np.int64)
        there = np.flatnonzero(np.diff(self.first))
        if len(there):
            self.bound[there] = np.maximum.reduceat(self.adds, self.first[there])

    def best(self, terms: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k highest scores above 0, equal ones by document, ascending."""
        terms = sorted((t for t in terms if self.bound[t]), key=lambda t: self.bound[t])
        lists = [(self.doc[a:b], self.adds[a:b]) for a, b in ((self.first[t], self.first[t + 1]) for t in terms)]
        bounds = np.cumsum([int(self.bound[t]) for t in terms])  # of each term with all lower ones
        top, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        begin, step, optional = 0, FIRST_BLOCK, 0
        # Later documents lose ties, so they need a score above the k-th best; scores are whole numbers.
        while begin < self.size and optional < len(terms):
            stop = min(begin + step, self.size)
            least = int(scores[-1]) + 1 if len(scores) == k else 1
            found = np.zeros(stop - begin, np.int64)
            for docs, adds in lists[optional:]:
                a, b = np.searchsorted(docs, (begin, stop))
                found[docs[a:b] - begin] += adds[a:b]
            here = np.flatnonzero(found)
            score = found[here]
            for j in range(optional - 1, -1, -1):
                can = score + bounds[j] >= least
                here, score = here[can], score[can]
                if not len(here):
                    break
                docs, adds = lists[j]
                at = np.minimum(np.searchsorted(docs, here + begin), len(docs) - 1)
                score += np.where(docs[at] == here + begin, adds[at], 0)
            can = score >= least
            if can.any():
                top, scores = np.r_[top, here[can] + begin], np.r_[scores, score[can]]
                order = np.lexsort((top, -scores))[:k]
                top, scores = top[order], scores[order]
                if len(scores) == k:
                    optional = int(np.searchsorted(bounds, int(scores[-1]) + 1))  # terms that together stay below that
            begin, step = stop, min(step * 2, LAST_BLOCK)
        return top, scores


def _postings(docs: DataFrame, terms: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, terms, times of every document with a term of its own; terms: those that the items have too."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        get = terms.get
        for batch in slices(batches):
            keep, n, which, times = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = terms_of(text)
                if words:
                    found = Counter(map(get, words))
                    found.pop(None, None)
                    keep.append(i)
                    n.append(len(words))
                    which.append(list(found))
                    times.append(list(found.values()))
            ints = pa.list_(pa.int32())
            yield pa.record_batch([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(which, ints), pa.array(times, ints)], ["doc_id", "n", "terms", "times"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, times array<int>")


def _search_block(docs: DataFrame, items: list[tuple], k: int, id_col: str, text_col: str, item_type: str) -> DataFrame:
    """item_id, row (of items), doc_id, score: the best of each shard for each item."""
    terms: dict[bytes, int] = {}
    asked = [sorted({terms.setdefault(t, len(terms)) for t in terms_of(text)}) for _, text in items]
    names, kind = [i for i, _ in items], docs.schema[id_col].dataType.simpleString()
    held = common.materialize(_postings(docs, terms, id_col, text_col), "postings")
    n_docs, n_all = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = np.zeros(len(terms), np.int64)
    for t, df in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the items
        counts[t] = df
    weights = np.array([weight(n_docs, int(c)) for c in counts], np.int64)
    item_kind = pa.array([x for x in names if x is not None]).type if any(x is not None for x in names) else None

    def answer(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        n = table.column(1).to_numpy()
        which, times = (table.column(c).combine_chunks() for c in (2, 3))
        size = np.diff(which.offsets.to_numpy())
        shard = Shard(n, which.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(n)), size), times.flatten().to_numpy().astype(np.int64), weights, n_docs, n_all)
        at, scores, who = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for q, wanted in enumerate(asked):
            top, score = shard.best(wanted, k)
            at.append(top)
            scores.append(score)
            who.append(np.full(len(top), q))
        rows_of = np.concatenate(who)
        ids = pa.array([names[q] for q in rows_of.tolist()], item_kind)
        return pa.record_batch([ids, pa.array(rows_of), table.column(0).combine_chunks().take(pa.array(np.concatenate(at))), pa.array(np.concatenate(scores))], ["item_id", "row", "doc_id", "score"])

    def run(batches):
        rows, n = [], 0
        for batch in batches:
            rows.append(batch)
            n += len(batch.column(2).flatten())
            if n >= SHARD_POSTINGS:
                yield answer(rows)
                rows, n = [], 0
        if rows:
            yield answer(rows)

    # By id within each task, so that places in a shard order as ids do.
    return held.sortWithinPartitions(F.asc_nulls_last("doc_id")).mapInArrow(run, f"item_id {item_type}, row bigint, doc_id {kind}, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of the highest score above 0 for each item, all if fewer.

    Equal scores go by ascending doc_id, nulls last. Items are a stated set: some thousands are answered by one pass over
    the documents, more by further passes; each row is an item of its own. Items without terms, null ones too, and an
    empty table of documents give no rows. Rows that repeat a document count as further documents.
    """
    common.ship(docs.sparkSession)
    item_type = items.schema[item_col].dataType.simpleString()
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("body"))
    passes = max(1, math.ceil(asked.count() / ITEMS))
    asked = common.materialize(asked.withColumn("turn", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(passes))), "items") if passes > 1 else asked.withColumn("turn", F.lit(0))
    found: DataFrame | None = None
    for turn in range(passes):
        block = [(r[0], r[1]) for r in asked.where(F.col("turn") == turn).select("item_id", "body").collect()]
        got = _search_block(docs, block, k, id_col, text_col, item_type)
        w = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        got = got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        found = got if found is None else found.unionByName(got)
    return found
