"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import slices
from .components import connected_components

#: Fingerprints in one block up to which they are paired; fuller blocks go through one-bit neighbours, without pairs.
CROWD = 16


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64. No words: zero. Fewer words than width: one shingle."""
    words = text.encode("utf-8").lower().split()  # of bytes: A-Z only, and blanks and 9 to 13 only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    xxh = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    n = len(words) - width + 1
    for at in range(0, n, 20_000):
        part = slice(at, min(at + 20_000, n))
        lo, hi = starts[part].tolist(), ends[width - 1 :][part].tolist()
        h = np.array([xxh(line[s:e], seed) for s, e in zip(lo, hi, strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row; null text: no words."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in slices(batches):
            fp = np.array([fingerprint(t or "", width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp bigint")


def links(fps: DataFrame, bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) of distinct fingerprints fps(fp) whose components are those of all pairs at most `bits` (2) bits apart.

    Fingerprints are cut into four blocks of 16 bits: at most two differ, so two stay equal, and each of the six
    pairs of blocks is a join key. Blocks of up to `crowd` fingerprints are paired and the Hamming distance checked.
    In fuller ones each fingerprint names itself and its 64 one-bit neighbours: two share a name exactly if they are
    at most two bits apart, and at most 65 share one; each is linked to the smallest of that name.
    """
    if bits != 2:
        raise ValueError("blocks and neighbours are laid out for two bits")

    def block(i: int):
        return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))

    keys = [F.struct(F.lit(k).alias("which"), (block(i) * 65536 + block(j)).alias("key")) for k, (i, j) in enumerate(combinations(range(4), 2))]
    blocks = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.which", "k.key")
    full = common.materialize(blocks.groupBy("which", "key").count().where("count > 1"), "blocks")
    shared = common.materialize(blocks.join(full, ["which", "key"]), "shared")
    few = shared.where(F.col("count") <= crowd).select("which", "key", "fp")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["which", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    crowded = shared.where(F.col("count") > crowd).select("fp").distinct()
    flips = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")) for b in range(64)]]
    names = crowded.select("fp", F.explode(F.array(*flips)).alias("name"))
    least = names.groupBy("name").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("name", "a")
    hubs = names.join(least, "name").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(hubs).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links, itself included) of every row of docs.

    Rows without words have fingerprint zero and are linked like any other. Equal fingerprints are one node, so copies
    make no pairs; repeated rows repeat. A null doc_id is no component_id unless its whole component has none.
    """
    rows = common.materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    member = connected_components(links(nodes.select("fp"), bits))
    member = member.join(nodes, member["node"] == nodes["fp"]).select("fp", "root", "least")
    smallest = member.groupBy("root").agg(F.min("least").alias("smallest"))
    linked = member.join(smallest, "root").select("fp", "smallest")
    component = nodes.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))
    # As a table of its own it is plainly shuffled for the last join, so a hot fingerprint's rows can be split.
    component = common.materialize(component, "component")
    return rows.join(component, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, width: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, all columns as they were. Rows that repeat a doc_id stay or go together; null ids stay."""
    gone = near_duplicates(docs, width, bits, id_col, text_col).where("doc_id <> component_id").select("doc_id").distinct()
    key = common.fresh(docs, "tess_gone")
    return docs.join(gone.withColumnRenamed("doc_id", key), F.col(id_col) == F.col(key), "left_anti")


#: Wide fingerprints: longs of the one that is compared, blocks of the one that is only looked up, bits of a block.
WIDE, BLOCKS, BLOCK_BITS = 16, 32, 24
#: Fingerprints may be as far apart as those of texts this much less alike: three times their scatter. Shingles decide.
SLACK = 0.08
#: Rows of a crowded block, or shingles of a group, that one part holds.
PART, PART_SHINGLES = 4096, 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def majority(hashes: np.ndarray, longs: int) -> np.ndarray:
    """longs * 64 bits over distinct hashes, each of which is stretched to that many bits; a bit is set if it is in over half."""
    h = np.unique(hashes)
    total = np.zeros(longs * 64, np.int64)
    for at in range(0, len(h), 255 * 32):
        part = h[at : at + 255 * 32]
        with np.errstate(over="ignore"):
            x = part[:, None] + _STEP * np.arange(1, longs + 1, dtype=np.uint64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):  # sums of 255 bits fit into a byte
            total += np.add.reduce(bits[low : low + 255], axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)


def wide_fingerprint(text: str, width: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(fingerprint of the distinct shingles, block keys from that of the distinct words, the shingles' hashes in order); None without words.

    Edits change few words but `width` shingles each: words make the better keys, shingles the better measure.
    """
    words = text.encode("utf-8").lower().split()
    if not words:
        return None
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    xxh = xxhash.xxh64_intdigest
    shingles = np.array([xxh(line[s:e], seed) for s, e in zip(starts, stops, strict=False)], np.uint64)
    distinct = np.array([xxh(w, seed) for w in set(words)], np.uint64)
    bits = majority(distinct, BLOCKS * BLOCK_BITS // 64)
    keys = np.packbits(np.unpackbits(bits.view(np.uint8), bitorder="little").reshape(BLOCKS, BLOCK_BITS), axis=1, bitorder="little")
    padded = np.zeros((BLOCKS, 4), np.uint8)
    padded[:, : keys.shape[1]] = keys
    return majority(shingles, WIDE), padded.view(np.uint32)[:, 0], np.unique(shingles.astype(np.uint32))


def most_bits(similarity: float, longs: int = WIDE) -> int:
    """Differing bits that two sets of equal size and that Jaccard similarity are expected to have."""
    return int(np.arccos(2 * similarity / (1 + similarity)) / np.pi * longs * 64)


def distances(fps: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Bits in which each row of fps differs from fp."""
    return np.bitwise_count(fps ^ fp).sum(1, np.int64)


def apart(sets: list[np.ndarray], one: np.ndarray) -> np.ndarray:
    """One less the Jaccard similarity of each of the sorted sets and one."""
    both = np.fromiter((np.isin(x, one, assume_unique=True, kind="sort").sum() if len(x) and len(one) else 0 for x in sets), np.float64, len(sets))
    size = np.fromiter(map(len, sets), np.float64, len(sets)) + len(one) - both
    return 1 - np.divide(both, size, out=np.ones(len(sets)), where=size > 0)


def forest(far_from, n: int, most: float, linked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of n items at most `most` apart, no more than have the components of all such pairs.

    far_from(which, one): distances of items from one, in a metric. Every two are compared, unless one is in a component
    already or the triangle inequality puts them apart: what is more than most + r from a component's first item is more
    than most from each at r from it. linked: items, by number, that are known to be in one component.
    """
    rest, out = np.arange(n), []
    first = linked if linked is not None and len(linked) else rest[:1]
    while len(rest) and len(first):
        rest = rest[~np.isin(rest, first)] if len(first) > 1 or rest[0] != first[0] else rest[1:]
        far = far_from(rest, first[0])
        todo = list(zip(first.tolist(), far_from(first, first[0]).tolist(), strict=True))
        while todo and len(rest):
            at, r = todo.pop()
            can = np.flatnonzero(far <= most + r)
            near = can[far_from(rest[can], at) <= most] if r else can
            if len(near):
                out += [(int(at), int(x)) for x in rest[near]]
                todo += zip(rest[near].tolist(), far[near].tolist(), strict=True)
                stay = np.ones(len(rest), bool)
                stay[near] = False
                rest, far = rest[stay], far[stay]
        first = rest[:1]
    return out


def _far_bits(held: list) -> Callable:
    fps = np.stack(held).view(np.uint64)
    return lambda which, one: distances(fps[which], fps[one])


def _far_sets(held: list) -> Callable:
    sets = [x.view(np.uint32) for x in held]
    return lambda which, one: apart([sets[i] for i in which], sets[one])


def group_edges(members: DataFrame, near: Callable[[Column, Column], Column], far: Callable, most: float, part: int) -> DataFrame:
    """Edges (a, b) of members(which, key, n, row, fp, weight) that have the components of all pairs of a group (which, key) at most `most` apart.

    n: weight of the whole group. Groups up to `part` are compared in one task. In heavier ones all rows are held against
    the group's first row; what is near to it, be it a third of all rows, is one component and needs no more looks among
    itself. The others are dealt into parts, and every two parts are compared of which not both are near to the first row:
    no task holds more than two parts, comparisons grow as the square of what is unlike the first row only.
    near(fp, fp) says as a Column what far, of a list of fp, says as distances.
    """
    common.ship(members.sparkSession)
    group = ["which", "key", "lo", "hi"]
    zero = F.lit(0).cast("long")
    light = members.where(F.col("n") <= part).select("which", "key", zero.alias("lo"), zero.alias("hi"), "row", "fp", F.lit(False).alias("linked"))
    heavy = common.materialize(members.where(F.col("n") > part), "heavy")
    dealt, stars = light, None
    if not heavy.isEmpty():
        first = heavy.groupBy(F.col("which").alias("w"), F.col("key").alias("k")).agg(F.min("row").alias("first"), F.min_by("fp", "row").alias("fp1"))
        heavy = heavy.join(first, (heavy["which"] == first["w"]) & (heavy["key"] == first["k"])).withColumn("linked", (F.col("row") == F.col("first")) | near(F.col("fp"), F.col("fp1")))
        heavy = common.materialize(heavy.drop("w", "k", "fp1"), "starred")
        stars = heavy.where("linked AND row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))
        sizes = heavy.groupBy(F.col("which").alias("w"), F.col("key").alias("k")).agg(*[F.ceil(F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0)) / part).alias(x) for x, c in (("apart", ~F.col("linked")), ("near", F.col("linked")))])
        heavy = heavy.join(sizes.where("apart > 0"), (heavy["which"] == F.col("w")) & (heavy["key"] == F.col("k")))
        own = F.when(F.col("linked"), F.col("apart") + F.pmod(F.xxhash64("row"), F.col("near"))).otherwise(F.pmod(F.xxhash64("row"), F.col("apart")))
        others = F.sequence(zero, F.when(F.col("linked"), F.col("apart")).otherwise(F.col("apart") + F.col("near")) - 1)
        heavy = heavy.withColumn("own", own).withColumn("other", F.explode(F.filter(others, lambda q: q != F.col("own"))))
        dealt = dealt.unionByName(heavy.select("which", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "row", "fp", "linked"))
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)

    def edges(held):
        rows = [h[0] for h in held]
        known = np.flatnonzero([h[2] for h in held])
        pairs = forest(far([h[1] for h in held]), len(rows), most, known)
        return [(min(rows[i], rows[j]), max(rows[i], rows[j])) for i, j in pairs]

    def run(batches):
        at, held, out = None, [], []
        for batch in batches:
            names = list(zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True))
            rows, linked = batch.column(4).to_pylist(), batch.column(6).to_pylist()
            values, offsets = batch.column(5).values.to_numpy(), batch.column(5).offsets.to_numpy()
            for k, name in enumerate(names):
                if name != at:
                    out += edges(held) if len(held) > 1 else []
                    at, held = name, []
                held.append((rows[k], values[offsets[k] : offsets[k + 1]].copy(), linked[k]))
            yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
            out = []
        out = edges(held) if len(held) > 1 else []
        yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    found = dealt.mapInArrow(run, "a bigint, b bigint")
    return found if stars is None else found.unionByName(stars)


def _bits_apart(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def similar_pairs(rows: DataFrame, bits: int, crowd: int = CROWD, part: int = PART) -> DataFrame:
    """Edges (a, b) of rows(row, fp, keys) with the components of all pairs that share a block and differ in at most `bits` bits of fp.

    Blocks of up to `crowd` rows are paired, fuller ones go through group_edges(): both compare all of a block.
    """
    blocks = rows.select("row", F.posexplode("keys").alias("which", "key"))
    full = blocks.groupBy("which", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = common.materialize(blocks.join(full, ["which", "key"]), "shared")
    few = shared.where(F.col("n") <= crowd).select("which", "key", "row")
    pairs = few.withColumnRenamed("row", "a").join(few.withColumnRenamed("row", "b"), ["which", "key"]).where("a < b").select("a", "b").distinct()
    for c in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("row").alias(f"row_{c}"), F.col("fp").alias(f"fp_{c}")), F.col(c) == F.col(f"row_{c}")).drop(f"row_{c}")
    members = shared.where(F.col("n") > crowd).join(rows.select("row", "fp"), "row").withColumn("weight", F.lit(1))
    crowded = group_edges(members, lambda a, b: _bits_apart(a, b) <= bits, _far_bits, bits, part)
    return pairs.where(_bits_apart(F.col("fp_a"), F.col("fp_b")) <= bits).select("a", "b").unionByName(crowded)


def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of rows whose shingles of `width` words are alike; rows without a partner don't appear.

    Components of wide fingerprints that are near enough hold the candidates; within each, links are pairs whose sets of
    shingles (by 32-bit hashes) have a Jaccard similarity from `similarity` up. Texts without words, null or empty, have
    no partner. component_id is the smallest doc_id of the component. An empty table gives no rows.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in slices(batches):
            found = [wide_fingerprint(t or "", width) for t in batch.column(1).to_pylist()]
            has = pa.array([f is not None for f in found])
            columns = [pa.array([f[i].view(kind) for f in found if f], pa.list_(to)) for i, kind, to in ((0, np.int64, pa.int64()), (1, np.int32, pa.int32()), (2, np.int32, pa.int32()))]
            yield pa.record_batch([batch.column(0).filter(has), *columns], ["doc_id", "fp", "keys", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp array<bigint>, keys array<int>, shingles array<int>")
    rows = common.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "wide")
    near = connected_components(similar_pairs(rows.select("row", "fp", "keys"), most_bits(similarity - SLACK)))
    sets = rows.select(F.col("row").alias("node"), F.col("shingles").alias("fp"), F.size("shingles").cast("long").alias("weight")).join(near, "node")
    sets = common.materialize(sets, "sets")
    total = sets.groupBy("root").agg(F.sum("weight").alias("n"))
    members = sets.join(total, "root").select(F.lit(0).alias("which"), F.col("root").alias("key"), "n", F.col("node").alias("row"), "fp", "weight")
    most = 1 - similarity + 1e-12
    member = connected_components(group_edges(members, lambda a, b: 1 - _jaccard(a, b) <= most, _far_sets, most, PART_SHINGLES))
    member = member.join(rows.select("row", "doc_id"), member["node"] == F.col("row")).select("doc_id", "root")
    return member.join(member.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def keep_one_similar(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group of similar texts, all columns as they were; null ids stay."""
    gone = similar_groups(docs, similarity, width, id_col, text_col).where("doc_id <> component_id").select("doc_id").distinct()
    key = common.fresh(docs, "tess_gone")
    return docs.join(gone.withColumnRenamed("doc_id", key), F.col(id_col) == F.col(key), "left_anti")
