"""Quality rules: an isolation forest on rule statistics, its threshold calibrated from labelled rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textstats
from .bpe import slices

TREES, SUBSAMPLE, SEED = 300, 32, 7
#: A good labelled row that is turned away weighs as many bad ones that are let through.
GOOD_WEIGHT = 20
#: Anomaly above which a text goes where no labelled row tells better.
DEFAULT_THRESHOLD = 0.65

#: Shares at which half of a mark's effect is reached; words from which on a text's own shares count in full.
HALF, FULL_WORDS = 0.1, 300


def points(counts: np.ndarray, usual: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """What the forest sees: shares of symbols, capitals and exclamation marks, saturating; of repeated lines and repeated
    words what goes beyond nearly all rows', saturating; mean word length, share of short words, logarithm of distinct words
    over that of words. The latter three scatter in short texts, so these are drawn towards the usual values.
    usual: shares of the two repetitions that 99 of 100 rows stay under, medians of the last three."""
    ratios = textstats.ratios(counts)
    n, distinct = counts[:, 0].astype(np.float64), counts[:, 9].astype(np.float64)
    marks = ratios[:, (0, 3, 4, 1, 2)]
    shares = np.column_stack([ratios[:, (5, 6)], np.log(distinct + 1) / np.log(n + 2)])
    if usual is not None:
        marks[:, 3:] = np.maximum(marks[:, 3:] - usual[0], 0)
        shares = usual[1] + (shares - usual[1]) * np.minimum(1.0, np.sqrt(n / FULL_WORDS))[:, None]
    return np.column_stack([marks / (marks + HALF), shares])


def shares(counts: np.ndarray) -> np.ndarray:
    """What usual values are taken of: shares of repeated lines and words, then the last three of points(); rounded, so
    that exact quantiles of any number of rows need at most 10,001 values a column."""
    found = np.column_stack([textstats.ratios(counts)[:, (1, 2)], points(counts)[:, 5:]])
    found[:, 2] = np.minimum(found[:, 2], 100) / 100
    found = np.round(found, 4)
    found[:, 2] *= 100
    return found


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, repeat = counts[:, 0], counts[:, 4]
    return (n < 50) | (100 * repeat > 50 * n)


def _usual_depth(n: np.ndarray | int) -> np.ndarray:
    """Mean depth at which a search in a random tree of n points ends."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random splits over subsamples; points that splits single out early are anomalous."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(rows))
        deepest = max(1, math.ceil(math.log2(max(self.size, 2))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], deepest, rng) for _ in range(trees)] if len(rows) else []

    @staticmethod
    def _grow(rows: np.ndarray, deepest: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, depth = [], [], [], [], []

        def node(x: np.ndarray, level: int) -> int:
            k = len(feature)
            feature.append(-1), cut.append(0.0), left.append(k), right.append(k), depth.append(level + float(_usual_depth(len(x))))
            wide = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
            if level < deepest and len(wide):
                f = int(rng.choice(wide))
                at = rng.uniform(x[:, f].min(), x[:, f].max())
                low = x[:, f] <= at
                feature[k], cut[k] = f, at
                left[k], right[k] = node(x[low], level + 1), node(x[~low], level + 1)
            return k

        node(rows, 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(depth)

    def settle(self, masses: list[tuple[int, int, int]]) -> None:
        """Depths anew from (tree, leaf, rows): a leaf counts by its share of all rows, as of a tree of the subsample's size."""
        found = {(t, leaf): n for t, leaf, n in masses}
        for k, (feature, cut, left, right, depth) in enumerate(self.trees):
            n = np.array([found.get((k, at), 0) for at in range(len(feature))], np.float64)
            here = n / max(n.sum(), 1) * self.size
            more = np.where(here < 2, np.maximum(here - 1, 0), _usual_depth(np.maximum(here, 2)))
            level = np.zeros(len(feature))
            for at in np.flatnonzero(feature >= 0):  # a node comes before those under it
                level[[left[at], right[at]]] = level[at] + 1
            self.trees[k] = feature, cut, left, right, np.where(feature < 0, level + more, depth)

    def leaves(self, seen: np.ndarray):
        """For each tree the leaf of every row."""
        rows = np.arange(len(seen))
        for feature, cut, left, right, _ in self.trees:
            at = np.zeros(len(seen), np.int64)
            while True:
                f = feature[at]
                if (f < 0).all():
                    break
                at = np.where(f < 0, at, np.where(seen[rows, f] <= cut[at], left[at], right[at]))
            yield at

    def anomaly(self, seen: np.ndarray) -> np.ndarray:
        """2 to the minus mean path length over the usual one: near 1 anomalous, under 0.5 ordinary."""
        if self.size < 2 or not len(seen):  # a single row tells nothing
            return np.zeros(len(seen))
        total = np.zeros(len(seen))
        for at, tree in zip(self.leaves(seen), self.trees, strict=True):
            total += tree[4][at]
        return 2.0 ** (-total / len(self.trees) / max(float(_usual_depth(self.size)), 1e-9))


class Rules:
    """Usual values, forest and threshold; small, so that it travels with the tasks."""

    def __init__(self, usual: tuple[np.ndarray, np.ndarray] | None, forest: IsolationForest, threshold: float = DEFAULT_THRESHOLD):
        self.usual, self.forest, self.threshold = usual, forest, threshold

    def judge(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        failed = base_failed(counts)
        score = self.forest.anomaly(points(counts, self.usual))
        return failed, score, ~failed & (score <= self.threshold)


def cuts(batches):
    """(first, last, good, bad, cost, low, high) of a task's scores(score, good, bad) in order: its least cost of a cut between two
    of its scores, counted from its first row on, and the widest gap of that cost. A task keeps no row."""
    first = last = low = high = None
    good = bad = cost = 0
    for batch in batches:
        for score, g, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if last is None:
                first = score
            else:
                here = bad - GOOD_WEIGHT * good
                if low is None or here < cost or (here == cost and score - last > high - low):
                    cost, low, high = here, last, score
            last, good, bad = score, good + g, bad + b
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"first": first, "last": last, "good": good, "bad": bad, "cost": cost, "low": low, "high": high}], CUTS)


CUTS = pa.schema([("first", pa.float64()), ("last", pa.float64()), ("good", pa.int64()), ("bad", pa.int64()), ("cost", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])


def calibrate(scores: DataFrame) -> float:
    """The threshold of least cost over all scores(score, good: whether the label is good); of equally cheap ones the middle of
    the widest stretch. Every distinct score counts; a row for each task reaches the driver."""
    each = scores.groupBy("score").agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad"))
    each = common.materialize(each, "scores").repartitionByRange("score").sortWithinPartitions("score")
    parts = sorted(tuple(r) for r in each.mapInArrow(cuts, "first double, last double, good long, bad long, cost long, low double, high double").collect())
    if not sum(p[2] for p in parts) or not sum(p[3] for p in parts):
        return DEFAULT_THRESHOLD
    options, before, at = [], 0, 0.0
    for first, last, good, bad, cost, low, high in parts:
        options.append((before, at - first, at, first))
        if low is not None:
            options.append((before + cost, low - high, low, high))
        before, at = before + bad - GOOD_WEIGHT * good, last
    options.append((before, at - 1.0, at, 1.0))
    _, _, low, high = min(options)
    return (low + high) / 2


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, the counts of textstats) of every row of docs."""
    common.ship(docs.sparkSession)
    names = [*textstats.BASE, *textstats.MORE]

    def run(batches):
        for batch in slices(batches):
            counts = textstats.table([t or "" for t in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), *[pa.array(c) for c in counts.T]], ["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in names))


def _counts(batch: pa.RecordBatch, start: int) -> np.ndarray:
    n = len(textstats.BASE) + len(textstats.MORE)
    return np.column_stack([batch.column(k).to_numpy() for k in range(start, start + n)]).astype(np.int64).reshape(batch.num_rows, n)


def learn(counted: DataFrame, labels: DataFrame) -> Rules:
    """Rules from every row of counted (see _counted()) that has a label and passes the base rules; labels: doc_id, quality 1 for
    good. Null qualities don't count; of contradicting labels the worse holds. No labelled row: every text that passes the
    base rules is kept.

    Usual values come from all of these rows, the forest from the half of them with even hashes of their ids, the threshold
    from all of the other half, which the forest has not seen. Each tree splits by rows of its own, drawn among all; how deep
    its leaves are is told by how many of all rows of the half end there.
    """
    names = [*textstats.BASE, *textstats.MORE]
    # Ids meet as text, so that those of documents and labels may differ in type.
    picked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("label_id")).agg(F.min("quality").alias("quality"))
    rows = counted.where("doc_id IS NOT NULL").withColumn("label_id", F.col("doc_id").cast("string")).join(picked, "label_id")

    def passed(batches):
        for batch in slices(batches):
            counts = _counts(batch, 2)
            keep = ~base_failed(counts)
            out = [*batch.columns, *[pa.array(c) for c in shares(counts).T]]
            yield pa.record_batch(out, ["label_id", "good", *names, *[f"s{i}" for i in range(5)]]).filter(pa.array(keep))

    form = "label_id string, good boolean, " + ", ".join(f"{c} bigint" for c in names) + ", " + ", ".join(f"s{i} double" for i in range(5))
    rows = common.materialize(rows.select("label_id", (F.col("quality") == 1).alias("good"), *names).mapInArrow(passed, form), "labelled")
    seen = F.pmod(F.xxhash64("label_id"), F.lit(2)) == 0
    *found, n = rows.agg(*[F.percentile(f"s{i}", 0.99 if i < 2 else 0.5) for i in range(5)], F.count(F.when(seen, 1))).first()
    usual = None if found[0] is None else (np.array(found[:2]), np.array(found[2:]))
    grown = rows.where(seen)
    # Rows of the trees: the first TREES * SUBSAMPLE of all by a hash; what lies far behind is left out before tasks send theirs.
    order, most = F.xxhash64("label_id", *names, F.lit(SEED)), TREES * SUBSAMPLE
    near = F.pmod(order, F.lit(1 << 30)) < math.ceil((1 << 30) * min(1.0, 1.5 * most / max(n, 1)))
    drawn = grown.where(near).orderBy(F.pmod(order, F.lit(1 << 30)), *names).select(*names).limit(most).collect()
    forest = IsolationForest(points(np.array(drawn, np.int64).reshape(len(drawn), len(names)), usual))

    def masses(batches):
        total = [np.zeros(len(t[0]), np.int64) for t in forest.trees]
        for batch in slices(batches):
            for k, at in enumerate(forest.leaves(points(_counts(batch, 0), usual))):
                total[k] += np.bincount(at, minlength=len(total[k]))
        for k, n in enumerate(total):
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])], ["tree", "leaf", "n"])

    # At most 2 * SUBSAMPLE numbers for each tree.
    forest.settle(grown.select(*names).mapInArrow(masses, "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n")).collect())

    def scored(batches):
        for batch in slices(batches):
            yield pa.record_batch([pa.array(forest.anomaly(points(_counts(batch, 1), usual))), batch.column(0)], ["score", "good"])

    return Rules(usual, forest, calibrate(rows.where(~seen).select("good", *names).mapInArrow(scored, "score double, good boolean")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Rules:
    """learn() from the texts of docs: all of them are counted."""
    return learn(common.materialize(_counted(docs, id_col, text_col), "counted"), labels)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of textstats, base_failed, anomaly, kept of every row of docs; null text: no words, so base_failed."""
    counted = common.materialize(_counted(docs, id_col, text_col), "counted")
    rules = learn(counted, labels)

    def run(batches):
        for batch in slices(batches):
            failed, score, kept = rules.judge(_counts(batch, 1))
            yield pa.record_batch([*batch.columns, pa.array(failed), pa.array(score), pa.array(kept)], [*batch.schema.names, "base_failed", "anomaly", "kept"])

    columns = ", ".join(f"{c} {kind}" for c, kind in counted.dtypes)
    return counted.mapInArrow(run, columns + ", base_failed boolean, anomaly double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, all columns as they were; no row moves between tasks.

    Null and empty texts go, as the base rules fail them; repeated rows stay or go together; an empty table stays empty.
    """
    rules = fit(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            kept = rules.judge(textstats.table([t or "" for t in batch.column(at).to_pylist()]))[2]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
