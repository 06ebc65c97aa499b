"""Hand-valued cases of matching and accuracy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.geometry import box, iou
from tessella.operators import matching as m
from tessella.sources.tables import view

FIELDS = "run_id long, page_number long, detector string, zone_type string, x double, y double, w double, h double, confidence double, o1 long"


def _zones(spark, rows):
    return spark.createDataFrame([(1, p, d, t, *map(float, b), float(c), i) for i, (p, d, t, b, c) in enumerate(rows)], FIELDS)


@pytest.mark.parametrize(("a", "b", "want"), [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (20, 20, 5, 5), 0.0), ((0, 0, 10, 10), (5, 0, 10, 10), 1 / 3), ((0, 0, 10, 10), (3, 3, 4, 4), 0.16), ((0, 0, 10, 10), (10, 0, 10, 10), 0.0), ((0, 0, 0, 10), (0, 0, 10, 10), 0.0)])
def test_overlap(spark, a, b, want):
    df = spark.createDataFrame([tuple(map(float, (*a, *b)))], "a_x double, a_y double, a_w double, a_h double, b_x double, b_y double, b_w double, b_h double")
    assert df.select(iou(box("a_"), box("b_"))).first()[0] == pytest.approx(want)


def test_greedy_matching_is_one_to_one(spark):
    z = _zones(spark, [(1, "A", "table", (0, 0, 10, 10), 0), (1, "A", "table", (0, 0, 10, 9), 0), (1, "B", "table", (0, 0, 10, 10), 0), (1, "B", "figure", (50, 50, 9, 9), 0), (2, "B", "table", (0, 0, 1, 1), 0), (3, "A", "figure", (0, 0, 10, 10), 0), (3, "B", "table", (0, 0, 10, 10), 0)])
    got = sorted((r["page_number"], r["a_order"] is not None, r["b_order"] is not None, r["bucket"]) for r in m.match_zones(z, ["run_id", "page_number"], ["o1"]).collect())
    assert got == [(1, False, True, "RED"), (1, True, False, "RED"), (1, True, True, "GREEN"), (2, False, True, "RED"), (3, True, True, "AMBER")]
    one = m.summarise_matches(m.match_zones(z.where("page_number = 1"), ["run_id", "page_number"], ["o1"]), ["run_id"]).first()
    assert one["green_pct"] == 33.3


def _ap(spark, truth, predicted):
    t, p = _zones(spark, truth), _zones(spark, predicted)
    return {r["zone_type"]: r["ap"] for r in m.average_precision(m.match_precision(t, p, ["run_id"], ["o1"]), t, ["run_id"], ["o1"]).collect()}


def test_average_precision(spark):
    boxes = [(i * 20, 0, 10, 10) for i in range(5)]
    truth = [(1, "A", "table", b, 0) for b in boxes]
    assert _ap(spark, truth, [(1, "B", "table", b, 0.9) for b in boxes])["table"] == pytest.approx(1.0)
    assert _ap(spark, truth, [(1, "B", "figure", b, 0.9) for b in boxes])["table"] == 0.0
    assert _ap(spark, truth, [(1, "B", "table", (500, 500, 5, 5), 0.9)])["table"] == 0.0
    # hit, miss, hit: recall 0.2, 0.2, 0.4 with precision 1, 1/2, 2/3
    some = [(1, "B", "table", boxes[0], 0.9), (1, "B", "table", (500, 0, 5, 5), 0.8), (1, "B", "table", boxes[1], 0.7)]
    assert _ap(spark, truth, some)["table"] == pytest.approx(0.2 + 0.2 * (1 / 2 + 2 / 3) / 2)


def test_classes_with_few_boxes_do_not_count(spark):
    df = spark.createDataFrame([(1, "table", 0.8, 5, 5), (1, "figure", 0.0, 4, 9), (1, "nonsense", 1.0, 50, 50)], "run_id long, zone_type string, ap double, n_truth long, n_predicted long")
    got = m.mean_average_precision(df, ["run_id"]).first()
    assert (got["overall_map"], got["n_valid"], got["n_short"]) == (0.8, 1, 1)


def test_results_do_not_depend_on_partitions(spark, sf):
    from tessella.sources.tables import view

    z = view(spark, sf, "zones")
    runs = [sorted(map(tuple, m.match_zones(z.repartition(n), ["run_id", "page_number"], ["o1", "o2", "o3", "o4"]).collect()), key=repr) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_merged_boxes_and_reading_order(spark):
    z = _zones(spark, [(1, "A", "table", (0, 0, 10, 10), 0), (1, "A", "table", (15, 0, 10, 10), 0), (1, "A", "table", (40, 0, 10, 10), 0), (1, "A", "table", (100, 100, 5, 5), 0)])
    got = sorted((r["x"], r["w"], r["n"]) for r in m.merge_boxes(z, ["run_id", "page_number"], 20.0).collect())
    assert got == [(0.0, 50.0, 3), (100.0, 5.0, 1)]
    two = _zones(spark, [(1, "A", "p", (60, 0, 30, 10), 0), (1, "A", "p", (0, 0, 30, 10), 0), (1, "A", "p", (0, 40, 30, 10), 0), (1, "A", "p", (60, 40, 30, 10), 0)])
    assert {r["o1"]: r["place"] for r in m.reading_order(two, ["run_id", "page_number"], ["o1"]).collect()} == {1: 1, 2: 2, 0: 3, 3: 4}
    assert m.duplicate_figures(z, ["run_id", "page_number"], ["o1"]).where(F.col("rejected")).count() == 0


def test_heading_levels_by_brute_force(spark, sf):
    from tessella.operators import auto_annotation as auto

    heads = view(spark, sf, "zones").where("zone_type = 'section-header'")
    order = ["page_number", "y", "o1", "o2", "o3", "o4"]
    got = sorted((r["run_id"], *[r[c] for c in order], r["level"]) for r in auto.heading_levels(heads, ["run_id"], order).collect())
    runs = {}
    for r in sorted(heads.select("run_id", *order, "h").collect(), key=tuple):
        runs.setdefault(r["run_id"], []).append(r)
    want = []
    for rows in runs.values():
        tops = []  # the tallest heading of each band
        for h in sorted((r["h"] for r in rows), reverse=True):
            if not tops or h < tops[-1] * 0.85:
                tops.append(h)
        before = 0
        for r in rows:
            band = min(6, sum(t >= r["h"] for t in tops))
            before = min(band, before + 1)
            want.append((*r[:-1], before))
    assert got == sorted(want) and {w[-1] for w in want} >= {1, 2, 3}
    assert auto.heading_levels(heads.limit(0), ["run_id"], order).count() == 0


def _random_zones(spark, n, seed, page=None):
    rng = np.random.default_rng(seed)
    size = 2.0 ** rng.uniform(-4, 9, (n, 2))
    at = rng.uniform(-500, 500, (n, 2))
    near = rng.integers(0, n, n // 2)  # half of them close to another box
    at[: n // 2], size[: n // 2] = at[near] + size[near] * rng.uniform(-0.4, 0.4, (n // 2, 2)), size[near] * 2 ** rng.uniform(-1, 1, (n // 2, 2))
    size[::50, 0] = 0
    rows = [(int(page if page is not None else i % 3), float(x), float(y), float(w), float(h), "T", "AB"[i % 2], i, 0, 0, 0) for i, ((x, y), (w, h)) in enumerate(zip(at, size, strict=True))]
    rows += [(1, float(2**k), 0.0, float(2**k), 8.0, "T", d, 10_000 + k, 0, 0, 0) for k in range(8) for d in "AB"] + [(1, 0.0, 0.0, w, 4.0, "T", d, 20_000, 0, 0, 0) for w, d in ((4.0, "A"), (8.0, "B"), (2.0, "B"))]
    rows.append((None, 0.0, 0.0, 4.0, 4.0, "T", "A", 30_000, 0, 0, 0))
    return spark.createDataFrame(rows, "page int, x double, y double, w double, h double, zone_type string, detector string, o1 long, o2 int, o3 int, o4 int"), rows


@pytest.mark.parametrize("page", [None, 1])
def test_candidate_pairs_by_brute_force(spark, page):
    zones, rows = _random_zones(spark, 1200, 5, page)
    a, b = [r for r in rows if r[6] == "A"], [r for r in rows if r[6] == "B"]
    overlap = m.iou_matrix(np.array([r[1:5] for r in a]), np.array([r[1:5] for r in b]))
    for threshold in (0.5, 0.3, 0.9):
        got = sorted((r["page"], r["a_o1"], r["b_o1"]) for r in m.candidate_pairs(zones, ["page"], threshold).collect())
        want = sorted((a[i][0], a[i][7], b[j][7]) for i, j in zip(*np.nonzero(overlap >= threshold), strict=True) if a[i][0] == b[j][0] and a[i][0] is not None)
        assert got == want and (len(got) > 10 or threshold == 0.9)
    plan = m.candidate_pairs(zones, ["page"])._jdf.queryExecution().executedPlan().toString()
    assert "_cell_x" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_matching_in_blocks(spark, monkeypatch):
    zones, _ = _random_zones(spark, 300, 6)
    whole = sorted(map(tuple, m.match_zones(zones, ["page"], ["o1"]).collect()), key=repr)
    monkeypatch.setattr(m, "ROWS_CELLS", 7)
    assert sorted(map(tuple, m.match_zones(zones, ["page"], ["o1"]).collect()), key=repr) == whole


def _on_a_grid(rng, n):
    return np.column_stack([rng.integers(0, 7, n) * 5, rng.integers(0, 4, n) * 5, rng.integers(0, 40, n), rng.integers(5, 25, n)]).astype(float)


def _anywhere(rng, n):
    return np.column_stack([rng.uniform(-20, 20, (n, 2)), 2.0 ** rng.uniform(-3, 4, (n, 2))])


@pytest.mark.parametrize("boxes", [_on_a_grid, _anywhere, lambda rng, n: np.zeros((n, 4)) + [0, 0, 3, 3]])
def test_matching_over_an_index(monkeypatch, boxes):
    monkeypatch.setattr(m, "BLOCK", 64)
    monkeypatch.setattr(m, "PLAIN_CELLS", 0)
    rng = np.random.default_rng(3)
    for n_a, n_b in ((300, 600), (700, 300), (1, 50), (50, 1), (40, 0)):
        a, b = boxes(rng, n_a), boxes(rng, n_b)
        for threshold in (0.3, 0.5, 0.9, 0.97):
            want, got = m._plain_greedy(a, b, threshold), m.greedy(a, b, threshold)
            assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_crowded_pages_are_not_crossed(monkeypatch):
    crossed = []
    real = m.iou_matrix
    monkeypatch.setattr(m, "iou_matrix", lambda a, b: crossed.append(len(a) * len(b)) or real(a, b))
    rng = np.random.default_rng(4)
    a, b = (np.column_stack([rng.uniform(0, 100, (n, 2)), rng.uniform(20, 70, (n, 2))]) for n in (3000, 6000))
    took, _ = m.greedy(a, b, 0.5)
    assert (took >= 0).mean() > 0.95 and sum(crossed) < 3000 * 6000 / 5


def test_model_delta_matches_its_runs_alone(spark, sf):
    from tessella.plans import QUERIES

    plan = QUERIES["ag43_model_delta"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    reads = [line for line in plan.split("\n") if "Filter" in line and "l_returnflag" in line]
    assert reads and all(re.search(r"% 16\) = [12]\)", line) for line in reads)


@pytest.mark.parametrize("boxes", [_on_a_grid, _anywhere])
def test_overlapping_by_brute_force(boxes):
    rng = np.random.default_rng(8)
    for n_a, n_b in ((300, 600), (700, 200), (1, 50), (0, 9)):
        a, b = boxes(rng, n_a), boxes(rng, n_b)
        for threshold in (0.3, 0.5, 0.97):
            want = m.iou_matrix(a, b)
            got = [(int(i[x]), int(j[y]), float(v[x, y])) for i, j, v, good in m.overlapping(a, b, threshold) for x, y in zip(*np.nonzero(good), strict=True)]
            assert sorted(got) == [(int(x), int(y), float(want[x, y])) for x, y in zip(*np.nonzero(want >= threshold), strict=True)]


@pytest.mark.parametrize("pairs", [1 << 33, 5000])
def test_counted_pairs_are_the_candidates(spark, monkeypatch, pairs):
    monkeypatch.setattr(m, "TASK_PAIRS", pairs)
    zones, _ = _random_zones(spark, 600, 7)
    zones = zones.withColumn("zone_type", F.when(F.col("o1") % 5 > 0, F.concat(F.lit("t"), F.col("o1") % 3)))
    same = F.count_if(F.col("a_zone_type") == F.col("b_zone_type"))
    want = m.candidate_pairs(zones, ["page"]).groupBy("page").agg(F.count("*").alias("pairs"), same.alias("same"), F.sum("iou").alias("total")).orderBy("page").collect()
    got = m.count_pairs(zones, ["page"]).orderBy("page").collect()
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_counting_makes_no_rows_of_pairs(spark, sf):
    from tessella.plans import QUERIES

    plan = QUERIES["mf1_iou_candidates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell_x" not in plan
