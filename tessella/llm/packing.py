"""Best-fit packing of token sequences in bulk-synchronous rounds.

Longest pieces come first, in bands of lengths. In each round the pieces of a band and the gaps of open sequences are
range-sorted together by size, distributed, and swept once from the largest down: a piece takes its successor, the
smallest gap met so far that holds it, and what is left of the gap waits for smaller pieces of the task. What a task
can't match by itself is carried on by rank: tasks report how many pieces and gaps they have left, which settles what
task's what gap each such piece gets, and a join brings the two together. Then gaps shrink and the next round begins;
where pieces are longer than every gap, new sequences open. Every round's state is a Parquet table, so lost executors
cost no round.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bpe import WORD_BPE, LibraryWordBpe, load, slices

CAPACITY, END_ID = 2048, 0
#: A band reaches from its longest piece down to a quarter of it.
BAND = 4
#: After so many rounds of a band all pieces that no gap holds get room at once, not only as many sequences as their tokens fill.
PATIENCE = 4
#: Rows of a round up to which one task sweeps them.
ONE_TASK = 30_000


def _sweep(batches) -> Iterator[pa.RecordBatch]:
    """What one task matches of its range of (size, piece, id), largest first, gaps before pieces of their size.

    what: 0 a piece (row, size) with its sequence, 1 a piece left over, 2 a gap left over that holds all smaller pieces;
    rank numbers the task's left pieces from the largest down and its left gaps from the smallest up, as they go on.
    """
    part = TaskContext.get().partitionId()
    names = ["part", "what", "rank", "seq", "row", "size"]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    # Gaps as numbers under zero in order, so that the smallest ones, which change, are at the end; whose they are.
    gaps: list[int] = []
    whose: list[int] = []
    left = size = 0

    def free(gap: int, seq: int) -> None:
        k = bisect_right(gaps, -gap)
        gaps.insert(k, -gap), whose.insert(k, seq)

    for batch in batches:
        out = []
        for size, piece, i in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if not piece:
                free(size, i)
            elif k := bisect_right(gaps, -size):
                gap, seq = -gaps.pop(k - 1), whose.pop(k - 1)
                out.append((part, 0, None, seq, i, size))
                if gap > size:
                    free(gap - size, seq)
            else:
                out.append((part, 1, left, None, i, size))
                left += 1
        yield table(out)
    n = bisect_right(gaps, -size)
    for at in range(0, n, 10_000):
        yield table([(part, 2, k, whose[n - 1 - k], None, None) for k in range(at, min(at + 10_000, n))])


def carry(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(part, low, high, gap_part, shift): pieces of part with ranks from low to below high take the gaps of gap_part with ranks + shift.

    left: for each task, by number, its left pieces and left gaps. Two numbers a task, whatever the rows.
    """
    out, stack = [], []
    for part, (pieces, gaps) in sorted(left.items()):
        at = 0
        while at < pieces and stack:
            of, first, n = stack.pop()
            take = min(n, pieces - at)
            out.append((part, at, at + take, of, first - at))
            at += take
            if take < n:
                stack.append((of, first + take, n - take))
        if gaps:
            stack.append((part, 0, gaps))
    return out


def match(slots: DataFrame, pieces: DataFrame, one: bool = False) -> DataFrame:
    """(row, size, seq) of all pieces(row, size): each takes its successor among slots(seq, size), longer pieces first; null without one.

    Of a slot that nothing was put into no piece is left that it would hold. one: the rows are few and swept by one task,
    which has nothing to carry on.
    """
    spark = pieces.sparkSession
    both = slots.select("size", F.lit(False).alias("piece"), F.col("seq").alias("id")).unionByName(pieces.select("size", F.lit(True).alias("piece"), F.col("row").alias("id")))
    # Many rows may have one size: the id's hash lets ranges part them.
    order = [F.col("size").desc(), F.col("piece"), F.xxhash64("id")]
    dealt = both.coalesce(1) if one else both.repartitionByRange(*order)
    swept = dealt.sortWithinPartitions(*order).mapInArrow(_sweep, "part int, what int, rank long, seq long, row long, size long")
    swept = common.materialize(swept, "swept")
    if one:
        return swept.where("what < 2").select("row", "size", "seq")
    left: dict[int, list[int]] = {}
    for part, what, n in swept.where("what > 0").groupBy("part", "what").count().collect():
        left.setdefault(part, [0, 0])[what - 1] = n
    moves = carry({k: (p, g) for k, (p, g) in left.items()})
    done = swept.where("what < 2").select("row", "size", "seq")
    if not moves:
        return done
    moves = F.broadcast(spark.createDataFrame(moves, "p int, low long, high long, gap_part int, shift long"))
    rest = swept.where("what = 1").select("part", "rank", "row", "size")
    rest = rest.join(moves, (rest["part"] == moves["p"]) & rest["rank"].between(moves["low"], moves["high"] - 1), "left")
    rest = rest.select("row", "size", "gap_part", (F.col("rank") + F.col("shift")).alias("gap_rank"))
    gaps = swept.where("what = 2").select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), "seq")
    return common.materialize(done.where("seq IS NOT NULL").unionByName(rest.join(gaps, ["gap_part", "gap_rank"], "left").select("row", "size", "seq")), "matched")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(row, size, seq) of every row of pieces(row, size): no sequence holds more than capacity. Rows must be distinct, sizes from 1 to capacity.

    Pieces over half the capacity open a sequence each, of their row's number; other sequences have numbers under zero.
    Of each round its counts by size reach the driver, which say how many sequences to open, and two numbers for each task.
    """
    spark = pieces.sparkSession
    alone = F.col("size") * 2 > capacity
    placed = pieces.where(alone).select("row", "size", F.col("row").alias("seq"))
    matched: list[str] = []
    bins = common.materialize(placed.where(F.col("size") < capacity).select("seq", (F.lit(capacity) - F.col("size")).alias("gap")), "bins")
    opened, high = 0, capacity // 2
    while high:
        low = high // BAND
        band = pieces.where(F.col("size").between(low + 1, high)).select("row", "size")
        high, rounds = low, 0
        while True:
            # At most `capacity` sizes of pieces, and as many of gaps.
            sizes = band.select(F.lit(True).alias("piece"), "size").unionByName(bins.select(F.lit(False).alias("piece"), F.col("gap").alias("size")))
            counts = {(p, k): n for p, k, n in sizes.groupBy("piece", "size").count().collect()}
            waits = {k: n for (p, k), n in counts.items() if p}
            if not waits:
                break
            rounds += 1
            least, most, n = min(waits), max(waits), sum(waits.values())
            holds = {k: m for (p, k), m in counts.items() if not p and k >= least}
            slots, new = bins.where(F.col("gap") >= least), 0
            stuck = {k: m for k, m in waits.items() if k > max(holds, default=0)}
            if stuck:
                by_tokens, by_pieces = -(-sum(k * m for k, m in stuck.items()) // capacity), -(-sum(stuck.values()) // (capacity // most))
                # One task takes new sequences one after another: what it leaves empty is none.
                new = by_tokens if rounds <= PATIENCE and 2 * n > ONE_TASK else by_pieces
                fresh = spark.range(-opened - new, -opened).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap"))
                opened, bins, slots = opened + new, bins.unionByName(fresh), slots.unionByName(fresh)
            gaps = sum(holds.values()) + new
            one = 2 * n + gaps <= ONE_TASK
            # A gap that holds several of the longest pieces takes as many of them, where pieces outnumber gaps.
            times = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / most), F.lit(1 if one else -(-n // gaps)))).cast("int")
            slots = slots.withColumn("times", times).select(F.floor(F.col("gap") / F.col("times")).alias("size"), F.explode(F.array_repeat("seq", F.col("times"))).alias("seq"))
            found = match(slots, band, one)
            put = found.where("seq IS NOT NULL")
            matched += found.inputFiles()
            band = found.where("seq IS NULL").select("row", "size")
            taken = bins.unionByName(put.select("seq", (-F.col("size")).alias("gap")))
            bins = common.materialize(taken.groupBy("seq").agg(F.sum("gap").alias("gap")).where((F.col("gap") > 0) & (F.col("gap") < capacity)), "bins")
    if not matched:
        return placed
    return placed.unionByName(spark.read.schema("row long, size long, seq long").parquet(*matched).where("row IS NOT NULL AND seq IS NOT NULL"))


def cut(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and a closing id 0, cut only where longer than capacity. Null text: empty."""
    path = path or common.tokenizer_file(WORD_BPE)
    common.ship(docs.sparkSession)
    end, width = END_ID.to_bytes(4, "little"), 4 * capacity

    def run(batches):
        bpe = load(path, LibraryWordBpe)
        for batch in slices(batches):
            doc, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = bpe.encode(text or "") + end
                for n, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    doc.append(row), piece.append(n), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """cut() with sequence_id and offset: no sequence holds more than capacity tokens, offsets in one have no gaps.

    Every row makes one piece at least (a null or empty text one of length 1); repeated rows and null ids are packed
    like others; an empty table gives no rows.
    """
    pieces = common.materialize(cut(docs, capacity, path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = place(pieces.select("row", F.col("length").alias("size")), capacity).select(F.col("row").alias("of"), F.col("seq").alias("sequence_id"))
    # A sequence has at most `capacity` pieces.
    before = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "row").rowsBetween(Window.unboundedPreceding, -1)
    out = pieces.join(placed, pieces["row"] == placed["of"]).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
