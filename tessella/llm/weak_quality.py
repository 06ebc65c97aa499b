"""Quality classifier without labels: expectation-maximisation over overlapping heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textstats
from .bpe import Memo, slices

DIMENSIONS = 4096
#: Rows that the scorer is fitted on: the first so many by the hash of doc_id. Votes are counted over all rows.
SAMPLE_ROWS = 2000
ROUNDS, STEPS, RIDGE = 100, 150, 1e-5

#: name, column of textstats.ratios(), bad below, good from, good to, bad above; between them it abstains.
LABELLERS = (
    ("symbols", 0, -1.0, 0.0, 0.01, 0.05),
    ("repeated_lines", 1, -1.0, 0.0, 0.34, 0.5),
    ("repeated_words", 2, -1.0, 0.0, 0.3, 0.6),
    ("upper_case", 3, -1.0, 0.0, 0.12, 0.3),
    ("exclamations", 4, -1.0, 0.0, 0.01, 0.05),
    ("word_length", 5, 3.0, 4.2, 6.0, 7.5),
    ("short_words", 6, 0.03, 0.12, 0.42, 0.9),
    ("distinct_words", 7, 0.25, 0.6, 1.0, 2.0),
    ("separators", 8, -1.0, 0.0, 0.03, 0.15),
)
GOOD, BAD, NONE = 0, 1, 2


#: Under so many words the shares below say little of a text, and their labellers abstain.
FEW_WORDS, UNSTEADY = 20, ("upper_case", "word_length", "short_words", "distinct_words", "separators")


def votes(counts: np.ndarray) -> np.ndarray:
    """GOOD, BAD or NONE of each labeller for each row of textstats.table()."""
    ratios = textstats.ratios(counts)
    few = counts[:, 0] < FEW_WORDS
    out = np.full((len(ratios), len(LABELLERS)), NONE, np.int8)
    for k, (name, c, low, good, to, high) in enumerate(LABELLERS):
        x = ratios[:, c]
        vote = np.where((x < low) | (x > high), BAD, np.where((x >= good) & (x <= to), GOOD, NONE))
        out[:, k] = np.where(few, NONE, vote) if name in UNSTEADY else vote
    return out


def estimate(patterns: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability that each pattern of votes is good, the labellers' rates [class, labeller, GOOD or BAD] and the share of good texts.

    Starts from the guess that any vote for bad is bad; then rates and labels explain each other until they settle.
    A labeller that abstains tells nothing.
    """
    if not len(patterns):
        return np.zeros(0), np.full((2, len(LABELLERS), 2), 0.5), 0.5
    good = np.where((patterns == BAD).any(1), 0.2, 0.95)
    share, rate = 0.5, np.zeros((2, patterns.shape[1], 2))
    for _ in range(rounds):
        for k, p in enumerate((good, 1 - good)):
            for v in (GOOD, BAD):
                rate[k, :, v] = ((patterns == v) * (weight * p)[:, None]).sum(0)
        rate = (rate + 0.5) / (rate + 0.5).sum(2, keepdims=True)
        share = (weight @ good + 1) / (weight.sum() + 2)
        tells = np.log(np.concatenate([rate, np.ones((2, patterns.shape[1], 1))], 2))
        like = [tells[k, np.arange(patterns.shape[1]), patterns].sum(1) for k in (0, 1)]
        before, good = good, 1 / (1 + np.exp(np.clip(like[1] + np.log(1 - share) - like[0] - np.log(share), -500, 500)))
        if np.abs(good - before).max() < 1e-9:
            break
    return good, rate, share


def _slot(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "surrogatepass")) % DIMENSIONS


def shape(word: str) -> str:
    """Classes of characters, runs at most twice: Word -> Aaa, 12!! -> 99!!."""
    out = ""
    for c in word:
        s = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if out[-2:] != s + s:
            out += s
    return out


def _document_slots(ratios: np.ndarray) -> np.ndarray:
    """Hashed features of a whole text: the tenth in which each statistic lies."""
    tenth = np.clip(np.floor(ratios * np.array([50, 10, 10, 10, 50, 1, 10, 10, 20])), 0, 10).astype(int)
    slots = np.array([[_slot("stat", f"{k}/{b}") for b in range(11)] for k in range(ratios.shape[1])])
    return slots[np.arange(ratios.shape[1]), tenth]


class Scorer:
    """Weights of hashed words and shapes, averaged over a text, plus those of its statistics."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias, self._memo = weight, bias, None

    def score(self, texts: list[str], counts: np.ndarray) -> np.ndarray:
        if self._memo is None:
            w = self.weight
            self._memo = Memo(lambda x: float(w[_slot("word", x)] + w[_slot("shape", shape(x))]))
        of = self._memo.__getitem__
        mean = np.array([sum(map(of, words)) / len(words) if (words := t.split()) else 0.0 for t in texts])
        z = mean + self.weight[_document_slots(textstats.ratios(counts))].sum(1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _features(text: str, slots: np.ndarray) -> dict[int, float]:
    words = text.split()
    x: dict[int, float] = {}
    for w in words:
        for s in (_slot("word", w), _slot("shape", shape(w))):
            x[s] = x.get(s, 0.0) + 1 / len(words)
    for s in slots.tolist():
        x[s] = x.get(s, 0.0) + 1.0
    return x


def train(rows: list[dict[int, float]], good: np.ndarray) -> Scorer:
    """Logistic regression on posterior labels, full gradient steps with momentum."""
    weight, bias = np.zeros(DIMENSIONS), 0.0
    if not rows:
        return Scorer(weight, bias)
    at = np.concatenate([np.full(len(x), i) for i, x in enumerate(rows)])
    slot = np.concatenate([np.fromiter(x, np.int64, len(x)) for x in rows])
    value = np.concatenate([np.fromiter(x.values(), np.float64, len(x)) for x in rows])
    speed, push = np.zeros(DIMENSIONS), 0.0
    for _ in range(STEPS):
        z = np.bincount(at, value * weight[slot], len(rows)) + bias
        off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - good
        speed = 0.9 * speed - 0.5 * (np.bincount(slot, value * off[at], DIMENSIONS) / len(rows) + RIDGE * weight)
        push = 0.9 * push - 0.5 * off.mean()
        weight, bias = weight + speed, bias + push
    return Scorer(weight, bias)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[Scorer, np.ndarray]:
    """The scorer and the labellers' rates. Vote patterns are counted over all rows; at most 3 ** labellers of them
    reach the driver. The scorer learns from sample_rows rows with their posterior labels."""
    common.ship(docs.sparkSession)

    def vote(batches):
        for batch in slices(batches):
            v = votes(textstats.table([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(["".join(map(str, r)) for r in v.tolist()], pa.string())], ["id", "hash", "pattern"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.xxhash64(common.text_of(text_col)).alias("hash"))
    voted = common.materialize(rows.mapInArrow(vote, f"id {kind}, hash bigint, pattern string"), "votes")
    counted = sorted((r[0], r[1]) for r in voted.groupBy("pattern").count().collect())
    patterns = np.array([list(map(int, p)) for p, _ in counted], np.int64).reshape(len(counted), len(LABELLERS))
    good, rate, _ = estimate(patterns, np.array([n for _, n in counted], np.float64))
    label = {p: float(g) for (p, _), g in zip(counted, good, strict=True)}

    # Ids and text hashes of the sample, at most sample_rows, are broadcast; repeated rows count once.
    picked = voted.select("id", "hash").distinct().orderBy(F.xxhash64("id"), "id", "hash").limit(sample_rows).select(F.col("id").alias("sample_id"), F.col("hash").alias("sample_hash"))

    def take(batches):
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = textstats.table(texts)
            x = [_features(t, s) for t, s in zip(texts, _document_slots(textstats.ratios(counts)), strict=True)]
            y = [label.get("".join(map(str, v)), 0.5) for v in votes(counts).tolist()]
            yield pa.record_batch([batch.column(0), pa.array([list(d) for d in x], pa.list_(pa.int32())), pa.array([list(d.values()) for d in x], pa.list_(pa.float64())), pa.array(y)], ["id", "slots", "shares", "good"])

    sample = rows.join(F.broadcast(picked), F.col("id").eqNullSafe(F.col("sample_id")) & (F.col("hash") == F.col("sample_hash"))).dropDuplicates(["id", "hash"])
    found = sample.select("id", "body").mapInArrow(take, f"id {kind}, slots array<int>, shares array<double>, good double").collect()
    found.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1], r[2]))
    return train([dict(zip(r[1], r[2], strict=True)) for r in found], np.array([r[3] for r in found])), rate


def classify(docs: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (probability that the text is good), kept (score from threshold) of every row of docs.

    Null and empty texts have no words and score by their statistics alone; repeated rows score alike.
    """
    scorer, _ = fit(docs, sample_rows, id_col, text_col)

    def run(batches):
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            score = scorer.score(texts, textstats.table(texts))
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array(score >= threshold)], ["doc_id", "score", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double, kept boolean")
