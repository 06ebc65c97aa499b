"""Region matching. Greedy kernels run per page, or per page and class: groups of tens of boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.geometry import box, iou
from tessella.functions.labels import CANONICAL
from tessella.functions.numbers import half_up
from tessella.operators.kernels import Columns, per_group

THRESHOLD, MIN_INSTANCES = 0.5, 5
#: Overlaps of a page that are held at once; groups with more pairs than PLAIN_CELLS are matched over an index.
ROWS_CELLS = 1 << 20
PLAIN_CELLS = 1 << 20
#: Boxes that are crossed at once with what may overlap them, cells of that; pairs of a page above which it is dealt to several tasks.
LEAF, CROSSED, TASK_PAIRS = 64, 1 << 17, 1 << 33
#: Overlaps by which the index looks for partners, one after the other; candidates that end the search; boxes that choose between two looks.
LEVELS, ENOUGH, BLOCK = (0.95, 0.92, 0.88, 0.82, 0.74, 0.63), 2, 1024


def _boxes(g: Columns) -> np.ndarray:
    return np.column_stack([g[c] for c in "xywh"]).astype(float)


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All pairs of rows x, y, w, h."""
    wide = np.minimum(a[:, None, 0] + a[:, None, 2], b[None, :, 0] + b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    high = np.minimum(a[:, None, 1] + a[:, None, 3], b[None, :, 1] + b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    inter = np.clip(wide, 0, None) * np.clip(high, 0, None)
    union = (a[:, 2] * a[:, 3])[:, None] + (b[:, 2] * b[:, 3])[None, :] - inter
    return np.where((inter > 0) & (union > 0), np.minimum(1.0, inter / np.where(union > 0, union, 1.0)), 0.0)


def _iou_rows(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """A row of iou_matrix for each of a, made some at a time, so that a page's boxes are never all crossed in memory."""
    step = max(1, ROWS_CELLS // max(len(b), 1))
    for k in range(0, len(a), step):
        yield from iou_matrix(a[k : k + step], b)


def _near(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of b, by bounds alone, that may overlap one of a by threshold: on each axis t of the union, so t/(1 + t) of both lengths, is shared."""
    share, keep = threshold / (1 + threshold) * (1 - 1e-9), np.ones(len(b), bool)
    for x in (0, 1):
        start, long, b_long = a[:, x], a[:, 2 + x], b[:, 2 + x]
        shared = np.minimum((start + long).max(), b[:, x] + b_long) - np.maximum(start.min(), b[:, x])
        keep &= np.minimum(np.minimum(shared, b_long), long.max()) >= share * (b_long + long.min())
    return np.flatnonzero(keep)


def overlapping(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, their overlaps as a matrix, which of them are threshold (over 0) or more), blocks that hold each such pair once.

    a is halved along the axis in which it is most spread until few boxes are left; each half keeps the rows of b that its
    bounds allow. So work and memory grow with what lies close together.
    """
    some = [np.flatnonzero((v[:, 2] > 0) & (v[:, 3] > 0) & np.isfinite(v).all(1)) for v in (a, b)]
    stack = [(some[0], some[1])]
    while stack:
        i, j = stack.pop()
        if not len(i) or not len(j):
            continue
        box = a[i]
        j = j[_near(box, b[j], threshold)]
        if not len(j):
            continue
        long = box[:, 2:]
        centre = box[:, :2] + long / 2
        spread = np.r_[np.ptp(centre, 0) / long.mean(0), np.log(long.max(0) / long.min(0))]
        if len(i) <= LEAF or not spread.max() > 0:
            for k in range(0, len(i), LEAF):
                for c in range(0, len(j), CROSSED // LEAF):
                    rows, others = i[k : k + LEAF], j[c : c + CROSSED // LEAF]
                    value = _crossed(a[rows], b[others])
                    yield rows, others, value, value >= threshold
            continue
        by = np.column_stack([centre, long])[:, spread.argmax()]
        order = np.argpartition(by, len(i) // 2)
        stack += [(i[order[: len(i) // 2]], j), (i[order[len(i) // 2 :]], j)]


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """iou_matrix of boxes with an area, in fewer steps; 0 or less where they lie apart."""
    ends, b_ends = a[:, :2] + a[:, 2:], b[:, :2] + b[:, 2:]
    wide, high = (np.minimum(ends[:, None, x], b_ends[None, :, x]) - np.maximum(a[:, None, x], b[None, :, x]) for x in (0, 1))
    inter = np.maximum(wide, 0.0, out=wide)
    inter *= high
    union = (a[:, 2] * a[:, 3])[:, None] + (b[:, 2] * b[:, 3])[None, :]
    union -= inter
    return np.minimum(np.divide(inter, union, out=union), 1.0, out=union)


def iou_of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """iou_matrix of a row of a and the same row of b, by the same steps."""
    wide = np.minimum(a[:, 0] + a[:, 2], b[:, 0] + b[:, 2]) - np.maximum(a[:, 0], b[:, 0])
    high = np.minimum(a[:, 1] + a[:, 3], b[:, 1] + b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
    inter = np.clip(wide, 0, None) * np.clip(high, 0, None)
    union = a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - inter
    return np.where((inter > 0) & (union > 0), np.minimum(1.0, inter / np.where(union > 0, union, 1.0)), 0.0)


class BoxIndex:
    """Boxes by cells of size and centre, such that all that overlap a box by `level` or more lie in 36 cells.

    Overlap by t bounds the ratio of two widths by t and the distance of two centres by (1/t - 1)/2 of either width, so sizes
    go by powers of 1/t and a size's cells are as wide as twice that distance for its widest box; the same for heights.
    """

    _MIX = tuple(np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))

    def __init__(self, boxes: np.ndarray, which: np.ndarray, level: float):
        """which: the rows of boxes that are in the index."""
        self.base = np.log(1 / level) * (1 + 1e-9)
        self.side = (1 / level - 1) * (1 + 1e-9)
        size = [self._size(boxes[which, 2 + x]) for x in (0, 1)]
        cells = [np.floor((boxes[which, x] + boxes[which, 2 + x] / 2) / self._side(size[x])).astype(np.int64) for x in (0, 1)]
        keys = self._key(size[0], cells[0], size[1], cells[1])
        order = np.argsort(keys, kind="stable")
        self.rows, keys = which[order], keys[order]
        self.first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        self.keys, self.n = keys[self.first], np.diff(np.r_[self.first, len(keys)])

    def _size(self, length: np.ndarray) -> np.ndarray:
        return np.floor(np.log(length) / self.base).astype(np.int64)

    def _side(self, size: np.ndarray) -> np.ndarray:
        return np.exp((size + 1) * self.base) * self.side

    def _key(self, *parts: np.ndarray) -> np.ndarray:
        """Equal cells have equal keys; others that do only make for more candidates."""
        key = np.zeros(parts[0].shape, np.uint64)
        for p, m in zip(parts, self._MIX, strict=True):
            key = (key ^ p.astype(np.uint64)) * m
            key ^= key >> np.uint64(29)
        return key

    def cells_of(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, rows) of the 36 cells of each box: arrays of boxes x 36."""
        axes = []
        for x in (0, 1):
            size = self._size(a[:, 2 + x])[:, None] + np.array([-1, -1, 0, 0, 1, 1])
            centre = (a[:, x] + a[:, 2 + x] / 2)[:, None]
            axes.append((size, np.floor(centre / self._side(size) - 0.5).astype(np.int64) + np.array([0, 1, 0, 1, 0, 1])))
        shape = (len(a), 6, 6)
        (w, cx), (h, cy) = axes
        keys = self._key(*(np.broadcast_to(v, shape) for v in (w[:, :, None], cx[:, :, None], h[:, None, :], cy[:, None, :]))).reshape(len(a), 36)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return self.first[at], np.where(hit, self.n[at], 0)


def _plain_greedy(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    free, took, tops = np.ones(len(b), bool), np.full(len(a), -1), np.zeros(len(a))
    for i, overlap in enumerate(_iou_rows(a, b) if len(b) else ()):
        best = np.where(free, overlap, 0.0)
        k = int(best.argmax())
        tops[i] = best[k]
        if best[k] >= threshold and best[k] > 0:
            free[k], took[i] = False, k
    return took, tops


def _indexed_greedy(a: np.ndarray, b: np.ndarray, threshold: float, with_tops: bool) -> tuple[np.ndarray, np.ndarray]:
    """As _plain_greedy. Equal boxes of b are one entry, a queue of rows; a block of a finds its candidates among the entries
    that are left, by the highest level at which there are enough, and then chooses in order."""
    order = np.lexsort((b[:, 3], b[:, 2], b[:, 1], b[:, 0]))  # stable: rows of equal boxes stay in order
    sorted_ = b[order]
    begin = np.flatnonzero(np.r_[True, (sorted_[1:] != sorted_[:-1]).any(1)])
    boxes, sizes = sorted_[begin], np.diff(np.r_[begin, len(b)])
    # Only entries with an area overlap anything.
    left = np.where((boxes[:, 2] > 0) & (boxes[:, 3] > 0), sizes, 0)
    following, gone = order[begin].copy(), np.where(left > 0, len(a), -1)  # each entry's next row; who took its last one
    used = np.zeros(len(boxes), np.int64)
    took, tops = np.full(len(a), -1), np.zeros(len(a))
    solid = (a[:, 2] > 0) & (a[:, 3] > 0)
    levels = [*[t for t in LEVELS if t > threshold], threshold]
    skip, indices, indexed = 0, {}, 0

    def take(i: int, g: int, value: float) -> None:
        took[i], tops[i] = following[g], value
        used[g] += 1
        left[g] -= 1
        if left[g]:
            following[g] = order[begin[g] + used[g]]
        else:
            gone[g] = i

    for start in range(0, len(a), BLOCK):
        todo = start + np.flatnonzero(solid[start : start + BLOCK])
        free = np.flatnonzero(left > 0)
        if not len(free):
            break
        if len(free) * 2 < indexed or not indices:
            indices, indexed = {}, len(free)
        lists: dict[int, tuple[list, list, bool]] = {}
        for nth, level in enumerate(levels):
            last = nth == len(levels) - 1
            if nth < skip or not len(todo):
                continue
            if level not in indices:
                indices[level] = BoxIndex(boxes, free, level)
            index = indices[level]
            cell, n = index.cells_of(a[todo])
            turn = np.cumsum(n.sum(1)) // ROWS_CELLS
            cuts = np.flatnonzero(np.diff(turn)) + 1
            enough = np.zeros(len(todo), bool)
            for lo, hi in zip([0, *cuts], [*cuts, len(todo)], strict=True):
                each = n[lo:hi].ravel()
                total = int(each.sum())
                near = index.rows[np.arange(total) - np.repeat(np.cumsum(each) - each, each) + np.repeat(cell[lo:hi].ravel(), each)]
                who = np.repeat(np.arange(lo, hi), n[lo:hi].sum(1))
                who, near = (v[left[near] > 0] for v in (who, near))
                value = iou_of_pairs(a[todo[who]], boxes[near])
                good = value >= level
                who, near, value = who[good], near[good], value[good]
                by = np.lexsort((-value, who))
                who, near, value = who[by], near[by], value[by]
                ends = np.searchsorted(who, np.arange(lo, hi + 1))
                enough[lo:hi] = (np.diff(ends) >= ENOUGH) | last
                near, value = near.tolist(), value.tolist()
                for j in np.flatnonzero(enough[lo:hi]).tolist():
                    lists[int(todo[lo + j])] = near[ends[j] : ends[j + 1]], value[ends[j] : ends[j + 1]], last
            if not last and nth == skip and enough.sum() * 2 < len(todo):
                skip += 1
            todo = todo[~enough]
        for i in range(start, min(start + BLOCK, len(a))):
            if i not in lists:
                continue
            near, value, whole = lists[i]
            best, top = -1, 0.0
            for g, v in zip(near, value, strict=True):
                if v < top:
                    break
                if left[g] > 0 and (best < 0 or following[g] < following[best]):
                    best, top = g, v
            if best < 0 and not whole:  # all of them went within the block
                row = np.where(left > 0, iou_matrix(a[i : i + 1], boxes)[0], 0.0)
                top = float(row.max())
                equal = np.flatnonzero(row == top)
                best = int(equal[following[equal].argmin()]) if top >= threshold else -1
            if best >= 0 and top > 0:
                take(i, best, top)
    lone = np.flatnonzero((took < 0) & solid) if with_tops else ()
    if len(lone):  # the best overlap among what earlier ones left
        for i, overlap in zip(lone.tolist(), _iou_rows(a[lone], boxes), strict=True):
            tops[i] = np.where(gone > i, overlap, 0.0).max()
    return took, tops


def greedy(a: np.ndarray, b: np.ndarray, threshold: float, with_tops: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row of b or -1, overlap) of each row of a: in order, each takes the best row of b not yet taken (the first of equals)
    that it overlaps by threshold or more; one that takes none has its best overlap among those left (with_tops)."""
    if len(a) * len(b) > PLAIN_CELLS and 0 < threshold < 1 and np.isfinite(a).all() and np.isfinite(b).all():
        return _indexed_greedy(a, b, threshold, with_tops)
    return _plain_greedy(a, b, threshold)


def candidate_pairs(zones: DataFrame, keys: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a detector A and a detector B region of one page that overlap by threshold (over 0, at most 1) or more.

    A spatial join: overlap by t bounds how far sizes and centres of two boxes may differ, so width and height of a B box
    give the side of its cells, by powers of two, and it stands in the few cells that its partners' centres can lie in; an
    A box stands in one cell of every size that a partner can have. Each pair meets in one cell alone, and the cells' work
    grows with what lies close together, not with a page. Boxes without area and pages of null keys have no pairs.
    """
    columns = ("x", "y", "w", "h", "zone_type", "o1", "o2", "o3", "o4")
    slack = 1e-9  # for what rounding may move over a bound
    least, reach = threshold * (1 - slack), (1 / threshold - 1) / 2 + slack

    def level(size: Column) -> Column:
        return F.ceil(F.log2(size)).cast("int")

    def cell(at: Column, level: Column) -> Column:
        return F.floor(at / F.pow(F.lit(2.0), level)).cast("long")

    zones = zones.where("w > 0 AND h > 0")
    a = zones.where("detector = 'A'").select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = zones.where("detector = 'B'").select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns])
    cells = []
    for axis, size in (("x", "w"), ("y", "h")):
        long, centre = F.col(f"a_{size}"), F.col(f"a_{axis}") + F.col(f"a_{size}") / 2
        a = a.withColumn(f"_level_{axis}", F.explode(F.sequence(level(long * least), level(long / least)))).withColumn(f"_cell_{axis}", cell(centre, F.col(f"_level_{axis}")))
        long, centre = F.col(f"b_{size}"), F.col(f"b_{axis}") + F.col(f"b_{size}") / 2
        own = level(long)
        b = b.withColumn(f"_level_{axis}", own).withColumn(f"_cell_{axis}", F.explode(F.sequence(cell(centre - long * reach, own), cell(centre + long * reach, own))))
        cells += [f"_level_{axis}", f"_cell_{axis}"]
    return a.join(b, [*keys, *cells]).drop(*cells).withColumn("iou", iou(box("a_"), box("b_"))).where(F.col("iou") >= threshold)


def count_pairs(zones: DataFrame, keys: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """keys, pairs, same (of one type), total (of overlaps): candidate_pairs() counted by page, without a row for each pair.

    A page is one group, unless it has over TASK_PAIRS pairs: then its A boxes are dealt to several, each with all its B
    boxes. Pages without such pairs or with null keys don't come up.
    """
    first = F.col("detector") == "A"
    zones = zones.where(F.col("detector").isin("A", "B") & (F.col("w") > 0) & (F.col("h") > 0))
    for key in keys:
        zones = zones.where(F.col(key).isNotNull())
    sizes = zones.groupBy(*keys).agg(F.ceil(F.count_if(first).cast("double") * F.count_if(~first) / TASK_PAIRS).cast("int").alias("_parts")).where("_parts > 0")
    own = F.array(F.pmod(F.xxhash64(*"xywh"), F.col("_parts")).cast("int"))
    parted = zones.join(sizes, keys).withColumn("_part", F.explode(F.when(first, own).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))))

    def page(g: Columns) -> Columns:
        boxes, is_a = _boxes(g), g["detector"] == "A"
        names = {t: n for n, t in enumerate(dict.fromkeys(g["zone_type"].tolist())) if t is not None}
        a_type, b_type = (np.array([names.get(t, none) for t in g["zone_type"][m].tolist()], np.int32) for m, none in ((is_a, -1), (~is_a, -2)))
        pairs, same, total = 0, 0, 0.0
        for i, j, value, good in overlapping(boxes[is_a], boxes[~is_a], threshold):
            pairs += np.count_nonzero(good)
            same += np.count_nonzero(good & (a_type[i][:, None] == b_type[j][None, :]))
            total += float((value * good).sum())
        return {"pairs": np.array([pairs]), "same": np.array([same]), "total": np.array([total])}

    counted = per_group(parted, [*keys, "_part"], [], ["detector", "zone_type", *"xywh"], page, {"pairs": "bigint", "same": "bigint", "total": "double"})
    return counted.groupBy(*keys).agg(F.sum("pairs").alias("pairs"), F.sum("same").alias("same"), F.sum("total").alias("total")).where("pairs > 0")


def match_zones(zones: DataFrame, keys: list[str], order: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """One row per matched pair or lone region: keys, a_order, b_order (places in `order` on the page), a_type, b_type, iou, bucket.

    A's regions choose in order, each the best B region not yet taken (the first of equals); from threshold on they are
    matched: GREEN of the same type, AMBER of another. All others are RED; an A region shows its best overlap, a B region 0.
    """

    def page(g: Columns) -> Columns:
        first = g["detector"] == "A"
        a_type, b_type = g["zone_type"][first], g["zone_type"][~first]
        boxes = _boxes(g)
        took, tops = greedy(boxes[first], boxes[~first], threshold)
        paired = took >= 0
        free = np.ones(len(b_type), bool)
        free[took[paired]] = False
        lone = np.flatnonzero(free)
        nothing = np.full(len(lone), None)
        b_order, of_pair = np.full(len(took), None), np.full(len(took), None)
        b_order[paired], of_pair[paired] = took[paired], b_type[took[paired]]
        bucket = np.where(paired, np.where(a_type == of_pair, "GREEN", "AMBER"), "RED")
        return {
            "a_order": np.r_[np.arange(len(took)).astype(object), nothing],
            "b_order": np.r_[b_order, lone.astype(object)],
            "a_type": np.r_[a_type, nothing],
            "b_type": np.r_[of_pair, b_type[lone]],
            "iou": np.r_[tops, np.zeros(len(lone))],
            "bucket": np.r_[bucket.astype(object), np.full(len(lone), "RED", object)],
        }

    out = {"a_order": "bigint", "b_order": "bigint", "a_type": "string", "b_type": "string", "iou": "double", "bucket": "string"}
    return per_group(zones.where(F.col("detector").isin("A", "B")), keys, order, ["detector", "zone_type", *"xywh"], page, out)


def summarise_matches(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and shares (1 decimal) of GREEN, AMBER and RED."""
    n = F.count("*")
    counts = {c: F.count_if(F.col("bucket") == c.upper()) for c in ("green", "amber", "red")}
    return matches.groupBy(*keys).agg(*[v.alias(f"{k}_count") for k, v in counts.items()], n.alias("total_zones"), *[half_up(v / n * 100.0, 1).alias(f"{k}_pct") for k, v in counts.items()])


def match_precision(truth: DataFrame, predicted: DataFrame, keys: list[str], order: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Predictions with tp: keys + zone_type, confidence, place, tp. A truth box serves one prediction.

    A prediction looks at its own page and class alone, so pages are matched apart; within one the most confident chooses
    first, equals in `order`.
    """
    group = [*keys, "page_number", "zone_type"]

    def match(g: Columns) -> Columns:
        gt = g["is_truth"].astype(bool)
        pred = np.flatnonzero(~gt)
        pred = pred[np.argsort(-g["confidence"][pred], kind="stable")]
        boxes = _boxes(g)
        tp = (greedy(boxes[pred], boxes[gt], threshold, False)[0] >= 0).astype(np.int32)
        return {"confidence": g["confidence"][pred], **{c: g[c][pred] for c in order}, "tp": tp}

    names = [*group, "confidence", *order, *"xywh"]
    both = truth.select(*names, F.lit(True).alias("is_truth")).unionByName(predicted.select(*names, F.lit(False).alias("is_truth")))
    out = {"confidence": "double", **{c: predicted.schema[c].dataType.simpleString() for c in order}, "tp": "int"}
    return per_group(both, group, order, ["confidence", *order, *"xywh", "is_truth"], match, out)


def average_precision(matched: DataFrame, truth: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, zone_type, ap, n_truth, n_predicted: the trapezoid under the precision-recall curve from recall 0 on.

    Recall never falls along the ranking, so the curve's points are already in order of recall.
    """
    group = [*keys, "zone_type"]
    ranked = Window.partitionBy(*group).orderBy(F.col("confidence").desc(), *order)
    upto = ranked.rowsBetween(Window.unboundedPreceding, 0)
    totals = truth.groupBy(*group).agg(F.count("*").alias("n_truth"))
    points = matched.join(totals, group).withColumn("tps", F.sum("tp").over(upto)).withColumn("seen", F.count("*").over(upto))
    points = points.withColumn("precision", F.col("tps") / F.col("seen")).withColumn("recall", F.col("tps") / F.col("n_truth"))
    before = {c: F.lag(c).over(ranked) for c in ("precision", "recall")}
    area = (F.col("recall") - F.coalesce(before["recall"], F.lit(0.0))) * (F.col("precision") + F.coalesce(before["precision"], F.col("precision"))) / 2
    ap = points.withColumn("area", area).groupBy(*group).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum("area"))).alias("ap"), F.count("*").alias("n_predicted"))
    return totals.join(ap, group, "left").select(*group, F.coalesce("ap", F.lit(0.0)).alias("ap"), "n_truth", F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"))


def mean_average_precision(classes: DataFrame, keys: list[str], least: int = MIN_INSTANCES) -> DataFrame:
    """Mean AP (4 decimals) over canonical classes with at least `least` truth boxes; 0 if there is none."""
    known = classes.where(F.col("zone_type").isin(*CANONICAL))
    valid = F.col("n_truth") >= least
    return known.groupBy(*keys).agg(half_up(F.coalesce(F.avg(F.when(valid, F.col("ap"))), F.lit(0.0)), 4).alias("overall_map"), F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_short"))


def duplicate_figures(zones: DataFrame, keys: list[str], order: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Figures of a page that overlap an earlier one that stays: keys, order columns, rejected."""

    def page(g: Columns) -> Columns:
        boxes = _boxes(g)
        gone = np.zeros(len(boxes), bool)
        for i, overlap in enumerate(_iou_rows(boxes, boxes)):
            if not gone[i]:
                gone[i + 1 :] |= overlap[i + 1 :] >= threshold
        return {**{c: g[c] for c in order}, "rejected": gone}

    out = {**{c: zones.schema[c].dataType.simpleString() for c in order}, "rejected": "boolean"}
    return per_group(zones, keys, order, [*order, *"xywh"], page, out)


def merge_boxes(zones: DataFrame, keys: list[str], gap: float = 20.0) -> DataFrame:
    """Boxes of a page closer than gap, directly or over others, as one: keys, x, y, w, h, n."""

    def page(g: Columns) -> Columns:
        b = _boxes(g)
        lo, hi = b[:, :2], b[:, :2] + b[:, 2:]
        near = ((lo[:, None] - gap <= hi[None]) & (lo[None] - gap <= hi[:, None])).all(2)
        label = np.arange(len(b))
        while True:  # the smallest label spreads over neighbours until it settles
            new = np.where(near, label[None], len(b)).min(1)
            if (new == label).all():
                break
            label = new
        groups = [label == k for k in np.unique(label)]
        low, high = np.array([lo[m].min(0) for m in groups]), np.array([hi[m].max(0) for m in groups])
        return {"x": low[:, 0], "y": low[:, 1], "w": (high - low)[:, 0], "h": (high - low)[:, 1], "n": np.array([m.sum() for m in groups], np.int64)}

    return per_group(zones, keys, ["x", "y"], list("xywh"), page, {**dict.fromkeys("xywh", "double"), "n": "bigint"})


def reading_order(zones: DataFrame, keys: list[str], order: list[str], min_gap: float = 8.0) -> DataFrame:
    """keys, order columns, place: recursive cuts of the page at the widest empty band, columns before rows."""

    def widest(start: np.ndarray, end: np.ndarray) -> tuple[float, float]:
        at = np.argsort(start, kind="stable")
        reach = np.maximum.accumulate(end[at])[:-1]
        gaps = start[at][1:] - reach
        k = int(gaps.argmax()) if len(gaps) else -1
        return (float(gaps[k]), float(reach[k])) if k >= 0 else (0.0, 0.0)

    def cut(rows: np.ndarray, b: np.ndarray) -> list[int]:
        if len(rows) < 2:
            return rows.tolist()
        for axis in (0, 1):
            gap, at = widest(b[rows, axis], b[rows, axis] + b[rows, axis + 2])
            if gap >= min_gap:
                first = b[rows, axis] < at
                return cut(rows[first], b) + cut(rows[~first], b)
        return rows[np.lexsort((rows, b[rows, 0], b[rows, 1]))].tolist()

    def page(g: Columns) -> Columns:
        b = _boxes(g)
        place = np.empty(len(b), np.int64)
        place[cut(np.arange(len(b)), b)] = np.arange(1, len(b) + 1)
        return {**{c: g[c] for c in order}, "place": place}

    out = {**{c: zones.schema[c].dataType.simpleString() for c in order}, "place": "bigint"}
    return per_group(zones, keys, order, [*order, *"xywh"], page, out)


def widest_gap(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, gap: the widest stretch that no interval covers, by a running maximum of ends; 0 if there is none."""
    by = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col(start) - F.max(end).over(by)
    return intervals.select(*keys, gap.alias("gap")).groupBy(*keys).agg(F.greatest(F.lit(0.0), F.coalesce(F.max("gap"), F.lit(0.0))).alias("gap"))


def cluster_by_proximity(zones: DataFrame, keys: list[str], order: list[str], factor: float = 2.0) -> DataFrame:
    """Vertical clusters of a page: a box starts one where it lies further below all before it than factor times the upper median height."""
    height = zones.groupBy(*keys).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY h DESC)").alias("usual"))
    by = Window.partitionBy(*keys).orderBy("y", *order)
    z = zones.join(height, keys).withColumn("reach", F.max(F.col("y") + F.col("h")).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("reach").isNull() | (F.col("y") - F.col("reach") >= factor * F.col("usual")), 1).otherwise(0)
    z = z.withColumn("cluster", F.sum(new).over(by))
    return z.groupBy(*keys, "cluster").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.count("*").alias("n"))
