"""Search of works by free text: what a remote lookup of references would answer, over a table of known works.

An inverted index with BM25, cut by works into shards that fit into a task. Every task gets a shard and a share of the
queries, scores all works of the shard for some queries at a time in arrays, and gives the best of them; the best over
shards are merged. So pairs of a query and a work are never rows: what is shuffled are queries, once for each shard, and
the index, once for each task. Terms that many works hold are a dense matrix, the others lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.kernels import _starts

#: Postings of a shard, about; scores and postings of queries at once; cells of frequent terms, and the share of works from which on a term is one.
SHARD_POSTINGS, CELLS, DENSE_CELLS, FREQUENT = 1_000_000, 1 << 20, 1 << 22, 1 / 32
#: Queries that wait for each other at most.
QUERIES = 4096
#: How fast repeats of a term saturate, how much a work's length counts.
K1, B = 1.2, 0.75


def postings(works: DataFrame, key: str, terms: Column) -> DataFrame:
    """work, term, w: the weight of each term of a work, in thousandths; terms: array of strings.

    w = floor(1000 * idf * (k1 + 1) * tf / (tf + k1 * (1 - b + b * length / mean length))), idf = ln(1 + (N - df + 0.5) / (df + 0.5)),
    N counting the works with a term. A work without terms or with a null key has no postings; rows of one key are one work.
    """
    each = works.where(F.col(key).isNotNull()).select(F.col(key).alias("work"), F.explode(terms).alias("term"))
    counts = each.groupBy("work", "term").agg(F.count("*").alias("tf"))
    lengths = counts.groupBy("work").agg(F.sum("tf").alias("n"))
    whole = lengths.agg(F.count("*").alias("works"), F.sum("n").alias("all"))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(whole))
    idf = F.log(F.lit(1.0) + (F.col("works") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms_ = df.select("term", idf.alias("idf"), (F.col("works") / F.col("all")).alias("per"))
    tf = F.col("tf").cast("double")
    w = F.floor(F.lit(1000.0) * F.col("idf") * ((K1 + 1) * tf) / (tf + K1 * (1 - B + B * (F.col("n") * F.col("per")))))
    return counts.join(lengths, "work").join(terms_, "term").select("work", "term", w.alias("w"))


class Shard:
    """Postings of some works, held for the queries of a task."""

    def __init__(self, rows: pa.Table):
        """rows: term, works, weights, a row for each term."""
        terms, works, weights = (rows.column(c).combine_chunks() for c in ("term", "works", "weights"))
        self.terms, all_ = terms, works.flatten()
        names = all_.unique()
        self.works = names.take(pc.sort_indices(names))
        self.work = pc.index_in(all_, self.works).to_numpy().astype(np.int64)
        self.w = weights.flatten().to_numpy().astype(np.float64)
        self.size = np.diff(works.offsets.to_numpy()).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        n = len(self.works)
        often = np.argsort(-self.size, kind="stable")[: DENSE_CELLS // n]
        often = often[self.size[often] >= n * FREQUENT]
        self.row_of = np.full(len(terms), -1)
        self.row_of[often] = np.arange(len(often))
        self.dense, self.held = np.zeros((len(often), n)), np.zeros((len(often), n))
        at, which = self._postings(often)
        self.dense[which, self.work[at]], self.held[which, self.work[at]] = self.w[at], 1.0
        self.some_weigh_nothing = bool((self.w == 0).any())

    def _postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms' postings, and for each the place of its term."""
        size = self.size[terms]
        which = np.repeat(np.arange(len(terms)), size)
        return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + self.first[terms][which], which

    def best(self, n: int, query: np.ndarray, term: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, works, scores) of the k best works of each of n queries; query, term: distinct pairs in order of query."""
        listed = self.row_of[term] < 0
        cost = np.bincount(query, np.where(listed, self.size[term], 0), n) + len(self.works)
        turn = (np.cumsum(cost) // CELLS).astype(np.int64)
        cuts = np.flatnonzero(np.diff(turn)) + 1
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            lo, hi = np.searchsorted(query, (a, b))
            yield self._best(a, b - a, query[lo:hi] - a, term[lo:hi], k)

    def _best(self, start: int, n: int, query: np.ndarray, term: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wide, row = len(self.works), self.row_of[term]
        asked = np.zeros((n, len(self.dense)))
        asked[query[row >= 0], row[row >= 0]] = 1.0
        at, which = self._postings(term[row < 0])
        cell = query[row < 0][which] * wide + self.work[at]

        def sums(dense: np.ndarray, w: np.ndarray | None) -> np.ndarray:
            return asked @ dense + np.bincount(cell, w, n * wide).reshape(n, wide)

        score = sums(self.dense, self.w[at])  # whole numbers, exact in doubles
        there = sums(self.held, None) > 0 if self.some_weigh_nothing else score > 0
        order = np.where(there, score, -1).astype(np.int64) * wide + np.arange(wide - 1, -1, -1)  # equal scores go by work
        k = min(k, wide)
        top = np.argpartition(order, wide - k, axis=1)[:, wide - k :]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(order, top, 1), axis=1), 1)
        of, nth = np.nonzero(np.take_along_axis(there, top, 1))
        return of + start, top[of, nth], score[of, top[of, nth]].astype(np.int64)


def _answers(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """q, work, score; batches: part, kind, q, terms, term, works, weights, the postings (kind 0) of each part before its queries."""
    shard: Shard | None = None
    index: list[pa.RecordBatch] = []
    waiting: list[pa.RecordBatch] = []
    part = None

    def answer(last: bool) -> Iterator[pa.RecordBatch]:
        """The waiting queries, but for the last one if rows of it may follow."""
        nonlocal waiting, shard, index
        if not waiting:
            return
        if shard is None and index:
            shard, index = Shard(pa.Table.from_batches(index)), []
        rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        starts = _starts(rows, 1)
        end = rows.num_rows if last else int(starts[-1])
        waiting = [] if last else [rows.slice(end)]
        starts = starts[starts < end]
        if shard is None or not len(starts):
            return
        terms = rows.column("terms").slice(0, end)
        known = pc.index_in(terms.flatten(), shard.terms)
        row = np.repeat(np.arange(end), pc.list_value_length(terms).fill_null(0).to_numpy(zero_copy_only=False))
        query = np.searchsorted(starts, row, "right") - 1
        mine = known.is_valid().to_numpy(zero_copy_only=False)
        pairs = np.unique(query[mine] * len(shard.terms) + known.drop_null().to_numpy().astype(np.int64))
        for of, work, score in shard.best(len(starts), *np.divmod(pairs, len(shard.terms)), k):
            yield pa.record_batch([rows.column(0).take(pa.array(starts[of])), shard.works.take(pa.array(work)), pa.array(score)], ["q", "work", "score"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = _starts(batch, 2)
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            this, kind = batch.column(0)[int(a)].as_py(), batch.column(1)[int(a)].as_py()
            if this != part:
                yield from answer(True)
                part, shard, index = this, None, []
            piece = batch.slice(int(a), int(b - a))
            if kind == 0:
                index.append(piece.select(["term", "works", "weights"]))
            else:
                waiting.append(piece.select(["q", "terms"]))
        if sum(p.num_rows for p in waiting) >= QUERIES:
            yield from answer(False)
    yield from answer(True)


def search(queries: DataFrame, key: str, terms: Column, index: DataFrame, k: int = 5) -> DataFrame:
    """key, rank (from 1), work, score of the k best works of each query; index: postings(); terms: array of strings.

    A query's terms count once; equal scores go by work, ascending; works that share no term don't come up, so a query
    may have fewer rows, or none (null, empty or unknown terms). Rows of one key are one query, a null key none. The index
    is counted when this is called, to see how many shards it needs.
    """
    # A part is a shard and a share of the queries: each shard goes to all its parts, each query to the parts of its share.
    shards = max(1, math.ceil(index.count() / SHARD_POSTINGS))
    tasks = 4 * queries.sparkSession.sparkContext.defaultParallelism
    q_type, work_type = queries.schema[key].dataType.simpleString(), index.schema["work"].dataType.simpleString()

    def row(kind: int, **given) -> list[Column]:
        columns = {"q": q_type, "terms": "array<string>", "term": "string", "works": f"array<{work_type}>", "weights": "array<bigint>"}
        return ["part", F.lit(kind).alias("kind"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()]]

    lists = index.groupBy("term", F.pmod(F.xxhash64("work"), F.lit(shards)).alias("shard")).agg(F.collect_list(F.struct("work", "w")).alias("p"))
    lists = lists.where("term IS NOT NULL").withColumn("part", F.explode(F.sequence(F.col("shard") * tasks, F.col("shard") * tasks + (tasks - 1))))
    asked = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("q"), F.array_distinct(terms).alias("asked")).where(F.size("asked") > 0)
    share = F.pmod(F.xxhash64("q"), F.lit(tasks))
    asked = asked.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: i * tasks + share)))
    both = lists.select(*row(0, term=F.col("term"), works=F.col("p.work"), weights=F.col("p.w"))).unionByName(asked.select(*row(1, q=F.col("q"), terms=F.col("asked"))))
    dealt = both.repartition(tasks * shards, "part").sortWithinPartitions("part", "kind", "q")
    found = dealt.mapInArrow(lambda batches: _answers(batches, k), f"q {q_type}, work {work_type}, score bigint")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "work"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(key), "rank", "work", "score")
