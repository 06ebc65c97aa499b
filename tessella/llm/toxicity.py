"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

Each word scores the lower bound of its log-odds between toxic and clean texts, the best of the whole word and its first
letters, with a Dirichlet prior from the whole corpus; a word without such evidence costs a little. One linear scan finds
every maximal segment of positive score. What scores come up in clean texts by chance follows an extreme-value law
(Karlin and Altschul), which turns a text's segments into one tail probability and that, by a logistic curve, into a
probability of the label.
"""

from __future__ import annotations

import math
import re
from itertools import groupby, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import Memo, slices

#: Features share so many counters; counters travel in pieces of CHUNK.
BUCKETS, CHUNK = 1 << 18, 1 << 10
#: Lengths of the beginnings of a word that count beside it.
STEMS = range(3, 8)
#: Weight of the corpus in each class, in windows; standard errors taken off; what every word costs.
PRIOR, ERRORS, DRIFT = 200.0, 3.0, 1.0
#: Words of a window; a feature counts once in each, so that counts grow with the length of texts and bursts don't count.
WINDOW = 64
#: About so many distinct labelled texts of each class are fitted to.
SAMPLE_ROWS = 20_000
#: A passage is significant if chance gives one like it to so few clean texts of its length.
SIGNIFICANT = 0.01
#: The largest evidence that is told apart, and the steps in which it is calibrated.
MOST, STEP = 200.0, 0.25
_MASK = BUCKETS - 1
_WORD = re.compile(r"[^\W\d_]+")


def _lower(text: str) -> str:
    """Lower case, one code point for each."""
    return text.replace("\u0130", "I").lower()


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; the same word over and over counts once."""
    words = _WORD.findall(_lower(text))
    return [a for a, b in pairwise(words) if a != b] + words[-1:]


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of words_of() stand, in code points; of a word over and over all of it."""
    same = groupby(_WORD.finditer(_lower(text)), lambda m: m[0])
    return [((each := [*found])[0].start(), each[-1].end()) for _, found in same]


def features(word: str) -> tuple[int, ...]:
    """Counters of a word and of its beginnings."""
    raw = [word + "\0", *[word[:k] for k in STEMS[: max(len(word) - STEMS.start + 1, 0)]]]
    return tuple([crc32(x.encode("utf-8", "surrogatepass")) & _MASK for x in raw])


def log_odds(counts: np.ndarray, sizes: np.ndarray, prior: float = PRIOR, errors: float = ERRORS) -> np.ndarray:
    """Lower bounds of the log-odds of each counter, toxic against clean; 0 where they are not above 0.

    counts: rows for all, clean and toxic windows that hold a feature; sizes: such windows in all. The prior of a class
    are `prior` windows that hold the feature as often as those of the corpus do.
    """
    every, clean, toxic = counts.astype(float)
    share = (every + 0.5) / (sizes[0] + 1.0)
    a, b = prior * share, prior * (1 - share)
    odds = np.log((toxic + a) / (sizes[2] - toxic + b)) - np.log((clean + a) / (sizes[1] - clean + b))
    return np.maximum(odds - errors * np.sqrt(1 / (toxic + a) + 1 / (clean + a)), 0.0)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal segments of positive score, in order, in one pass (Ruzzo and Tompa).

    Each segment found waits with the sums before and after it; a new one that ends higher swallows those back to the
    nearest that starts lower. Stretches without positive words are skipped as one sum.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.r_[0.0, np.cumsum(scores)]
    found: list[tuple[int, int, float, float]] = []
    lower: list[int] = []  # for each waiting segment the nearest earlier one that starts lower, or -1
    for i, low, high in zip(up.tolist(), total[up].tolist(), total[up + 1].tolist(), strict=True):
        start, end = i, i + 1
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = lower[j]
            if j < 0 or found[j][3] >= high:
                break
            start, low = found[j][0], found[j][2]
            del found[j:], lower[j:]
            j -= 1
        found.append((start, end, low, high))
        lower.append(j)
    return [(a, b, y - x) for a, b, x, y in found]


def tail_rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1, at which chance scores fall off; 0 if their mean isn't below 0."""
    low, high = 0.0, 1.0
    if (scores * share).sum() >= 0 or scores.max() <= 0:
        return 0.0
    while (share * np.exp(np.minimum(high * scores, 500))).sum() < 1:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return (low + high) / 2


class Scorer:
    """Log-odds and the law of chance; small, so that it travels with the tasks."""

    def __init__(self, table: np.ndarray, drift: float = DRIFT):
        self.table, self.drift = table.astype(np.float32), drift
        self.rate, self.scale, self.slope, self.base = 1.0, 1.0, 0.0, 0.0
        self._memo: Memo | None = None

    def __getstate__(self):
        return self.__dict__ | {"_memo": None}

    def word_scores(self, words: list[str]) -> np.ndarray:
        if self._memo is None:
            table, drift = self.table.tolist(), self.drift
            self._memo = Memo(lambda w: max([table[k] for k in features(w)]) - drift)
        return np.fromiter(map(self._memo.__getitem__, words), np.float64, len(words))

    def evidence(self, n_words: int, found: list[tuple[int, int, float]]) -> float:
        """Minus the logarithm of the smallest tail probability of the best r segments together, over all r.

        With a normed score x = rate * score - ln(scale * words) of each, r of them sum to t by chance with a probability
        of about exp(-t) * t ** (r - 1) / (r! * (r - 1)!) (Karlin and Altschul 1993).
        """
        best, t = 0.0, 0.0
        size = math.log(max(self.scale * n_words, 1.0))
        for r, s in enumerate(sorted((x[2] for x in found), reverse=True), 1):
            t += self.rate * s - size
            if r == 1:
                p = -math.log(-math.expm1(-math.exp(-t))) if t < 30 else t
            elif t > r:
                p = t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r)
            else:
                continue
            best = max(best, p)
        return min(best, MOST)

    def passages(self, text: str, n_words: int, found: list[tuple[int, int, float]]) -> list[dict]:
        """Significant segments: where they stand in code points, their scores and their odds by chance."""
        size = max(self.scale * n_words, 1.0)
        odds = [-math.expm1(-size * math.exp(-self.rate * x[2])) for x in found]
        if not any(p <= SIGNIFICANT for p in odds):
            return []
        at = word_spans(text)
        return [{"start": at[a][0], "end": at[b - 1][1], "score": s, "by_chance": p} for (a, b, s), p in zip(found, odds, strict=True) if p <= SIGNIFICANT]

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * np.log1p(evidence), -60, 60)))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """(key, toxic) of some sample_rows distinct texts of each class, by hash; how many rows are clean and toxic in all.

    Only hashes of texts move. Of copies the one with the smallest id stands for all; of contradicting labels toxic holds.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy(F.col("doc_id").cast("string").alias("key")).agg(F.max("toxic").alias("toxic"))
    texts = docs.where(~held_out(id_col)).select(F.col(id_col).cast("string").alias("key"), F.xxhash64(common.text_of(text_col)).alias("hash"))
    distinct = common.materialize(texts.join(known, "key").groupBy("hash").agg(F.min("key").alias("key"), F.max("toxic").alias("toxic"), F.count("*").alias("n")), "labelled")
    sizes, rows = np.zeros(2), np.zeros(2)
    for toxic, n, of in distinct.groupBy("toxic").agg(F.count("*"), F.sum("n")).collect():
        sizes[int(toxic == 1)] += n
        rows[int(toxic == 1)] += of
    share = np.minimum(sample_rows / np.maximum(sizes, 1), 1.0)
    drawn = F.pmod(F.xxhash64("hash"), F.lit(1 << 30)) / float(1 << 30) < F.when(F.col("toxic") == 1, float(share[1])).otherwise(float(share[0]))
    return distinct.where(drawn).select("key", (F.col("toxic") == 1).cast("int").alias("toxic")), rows


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Windows with each feature in all texts, clean and toxic ones of rows(body, toxic), and how many windows there are.

    Each task counts in arrays of one size and hands them on in pieces, which are summed where pieces of one number meet.
    """
    spark, fields = rows.sparkSession, "piece int, counts binary"

    def count(batches):
        seen = np.zeros((3, BUCKETS), np.int64)
        n = np.zeros(3, np.int64)
        memo = Memo(features)
        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text or "")
                for at in range(0, len(words), WINDOW):
                    found: set[int] = set()
                    for w in set(words[at : at + WINDOW]):
                        found.update(memo[w])
                    here = np.fromiter(found, np.int64, len(found))
                    for row in (0,) if toxic is None else (0, 1 + toxic):
                        seen[row, here] += 1
                        n[row] += 1
        pieces = [seen[:, k : k + CHUNK].tobytes() for k in range(0, BUCKETS, CHUNK)] + [n.tobytes()]
        yield pa.record_batch([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.int64)
                total[k] = total[k] + part if k in total else part
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["piece", "counts"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = rows.mapInArrow(count, fields).repartition(min(parts, BUCKETS // CHUNK), "piece").mapInArrow(add, fields)
    counts, sizes = np.zeros((3, BUCKETS), np.int64), np.zeros(3, np.int64)
    for k, raw in summed.collect():  # BUCKETS / CHUNK + 1 rows of one size
        part = np.frombuffer(raw, np.int64)
        if k * CHUNK < BUCKETS:
            counts[:, k * CHUNK : (k + 1) * CHUNK] = part.reshape(3, -1)
        else:
            sizes = part
    return counts, sizes


def _logistic(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """(base, slope) of the log-odds of good against bad at x, by Newton's method with a light ridge."""
    base = slope = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(base + slope * x, -30, 30)))
        gap, w = good * (1 - p) - bad * p, (good + bad) * p * (1 - p)
        grad = np.array([gap.sum() - 1e-3 * base, (gap * x).sum() - 1e-3 * slope])
        hess = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        base, slope = base + float(np.clip(step[0], -2, 2)), slope + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-9:
            break
    return base, slope


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """A scorer from labels (doc_id, toxic 1 or not) that are not held out.

    Counts of the corpus cover all texts; labels of about sample_rows distinct texts of each class are used. Where
    clean or toxic ones are missing nothing is told apart: every text gets the share of toxic rows, one quarter if there are no labels.
    """
    common.ship(docs.sparkSession)
    picked, rows = _sample(docs, labels, sample_rows, id_col, text_col)
    picked = F.broadcast(picked.select(F.col("key").alias("picked"), "toxic"))  # some 2 * sample_rows rows
    texts = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("body"))
    scorer = Scorer(log_odds(*_counts(texts.join(picked, F.col("key") == F.col("picked"), "left").select("body", "toxic"))))
    scorer.base = math.log((rows[1] + 0.5) / (rows[0] + 1.5))
    if not rows.all():
        return scorer
    labelled = texts.join(picked, F.col("key") == F.col("picked")).select("body", "toxic")

    def look(batches):
        seen: dict[float, int] = {}
        for batch in slices(batches):
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                scores = scorer.word_scores(words_of(text or ""))
                if not toxic:
                    for v, n in zip(*map(np.ndarray.tolist, np.unique(scores.round(2), return_counts=True)), strict=True):
                        seen[v] = seen.get(v, 0) + n
                out.append((toxic, len(scores), [x[2] for x in segments(scores)], None))
            yield pa.record_batch(list(map(pa.array, zip(*out, strict=True), kinds)), names)
        yield pa.record_batch([pa.array([None], kinds[0]), pa.array([0], kinds[1]), pa.array([list(seen)], kinds[2]), pa.array([list(seen.values())], kinds[3])], names)

    names = ["toxic", "words", "scores", "times"]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
    seen = common.materialize(labelled.mapInArrow(look, "toxic int, words bigint, scores array<double>, times array<bigint>"), "scores")
    by_chance = seen.where("toxic IS NULL").select(F.explode(F.arrays_zip("scores", "times")).alias("x")).groupBy("x.scores").agg(F.sum("x.times")).collect()  # a row for each hundredth
    # One word of the highest score beside those seen, so that the rate is finite where clean texts have none above 0.
    value = np.array([r[0] for r in by_chance] + [float(scorer.table.max()) - scorer.drift])
    share = np.array([r[1] for r in by_chance] + [1], float)
    scorer.rate = tail_rate(value, share / share.sum())
    clean, spread = seen.where("toxic = 0").agg(F.count("*"), F.sum(F.col("words") * F.exp(-scorer.rate * F.coalesce(F.array_max("scores"), F.lit(0.0))))).first()
    scorer.scale = clean / max(spread or 0.0, 1e-9)

    def weigh(batches):
        for batch in batches:
            found = [scorer.evidence(n, [(0, 0, s) for s in x]) for n, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array([round(x / STEP) for x in found], pa.int32())], ["toxic", "step"])

    steps = seen.where("toxic IS NOT NULL").mapInArrow(weigh, "toxic int, step int").groupBy("toxic", "step").count().collect()  # 2 * MOST / STEP rows at most
    n = np.zeros((2, int(MOST / STEP) + 1))
    for toxic, step, times in steps:
        n[toxic, step] += times
    n *= (rows / np.maximum(n.sum(1), 1))[:, None]  # as frequent as among all labelled rows
    scorer.base, scorer.slope = _logistic(np.log1p(np.arange(n.shape[1]) * STEP), n[1], n[0])
    return scorer


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (probability of toxic), predicted (1 from a half on), passages of every row of docs.

    passages: the significant ones in order, with start and end in code points. Whole texts are read; labels, ids and
    other columns play no part in a score, so equal texts score alike. A null text is an empty one and scores as one
    without evidence; repeated rows and null ids stay; an empty table gives no rows.
    """
    scorer = fit(docs, labels, sample_rows, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("by_chance", pa.float64())]))

    def run(batches):
        for batch in slices(batches):
            evidence, passages = [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text or "")
                found = segments(scorer.word_scores(words))
                evidence.append(scorer.evidence(len(words), found) if found else 0.0)
                passages.append(scorer.passages(text, len(words), found) if found else [])
            p = scorer.probability(np.array(evidence))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(passages, spans)], ["doc_id", "held_out", "score", "predicted", "passages"])

    fields = f"doc_id {kind}, held_out boolean, score double, predicted int, passages array<struct<start: bigint, end: bigint, score: double, by_chance: double>>"
    return docs.select(id_col, held_out(id_col).alias("_held_out"), text_col).mapInArrow(run, fields)
