"""Lineage lines and their file, seeded samples against a plain shuffle, rows kept by groups with columns of any type."""

import csv
import datetime as dt

from tessella.operators import export, kernels, relational
from tessella.sinks import files


def _zones(spark):
    rows = [
        ("r1", 2, 1, "table", None, "CONFIRMED", 0.5, "op, one"), ("r1", 1, 2, "figure", "caption", "CORRECTED", None, "=cmd"), ("r1", 1, 1, "figure", None, "CORRECTED", 0.25, None),
        ("r1", None, 9, "figure", "x", "REJECTED", 1.0, 'say "no"'), ("r2", 5, 1, "header", "y", None, 0.125, "ai:v1"),
    ]
    z = spark.createDataFrame(rows, "run_id string, page_number int, zone_id int, zone_type string, operator_label string, decision string, ai_confidence double, verified_by string")
    return z.selectExpr("*", "'a' AS a_label", "'b' AS b_label", "'GREEN' AS bucket", "'CONFIRMED' AS ai_decision", "zone_type AS ai_label", "'book' AS document", "if(run_id = 'r1', '2024-02-01', '2024-01-01') AS completed_at")


def test_lineage_by_hand(spark):
    placed = export.lineage(_zones(spark), "run_id", "page_number", ["zone_id"])
    got = {(r["run_id"], r["page_number"], r["zone_id"]): (r["zone_index"], r["human_label"], r["final_label"]) for r in placed.collect()}
    assert got == {("r1", None, 9): (0, None, None), ("r1", 1, 1): (1, None, "figure"), ("r1", 1, 2): (2, "caption", "caption"), ("r1", 2, 1): (3, "table", "table"), ("r2", 5, 1): (0, None, None)}


def test_lineage_file(spark, tmp_path):
    files.write_lineage(export.lineage(_zones(spark), "run_id", "page_number", ["zone_id"]), str(tmp_path / "out"))
    rows = []
    for part in sorted((tmp_path / "out").glob("part-*.csv")):
        with part.open(newline="") as f:
            head, *body = csv.reader(f)
        assert head == list(files.LINEAGE)
        rows += body
    assert [(r[0], r[5]) for r in rows] == [("r2", "0"), ("r1", "0"), ("r1", "1"), ("r1", "2"), ("r1", "3")]
    assert rows[1][14] == 'say "no"' and rows[3][14] == "'=cmd" and rows[4][14] == "op, one" and rows[3][11] == "" and rows[2][11] == "0.250"


def test_generator_and_shuffle():
    u = relational._uniform(42)
    assert [round(next(u), 6) for _ in range(3)] == [0.601104, 0.448291, 0.852466]
    for n in (0, 1, 2, 97):
        assert sorted(relational.seeded_places(n, 7)) == list(range(n))
    assert relational.seeded_places(50, 7) == relational.seeded_places(50, 7) != relational.seeded_places(50, 8)


def test_seeded_sample(spark):
    rows = [(g, p) for g in ("a", "b", None) for p in [*range(1, 40), *range(1, 40), None]] + [("few", 3), ("few", 8)]
    df = spark.createDataFrame(rows, "g string, page int")
    got = {}
    for r in relational.seeded_sample(df, ["g"], "page", 5, 42, most=30).collect():
        got.setdefault(r["g"], {})[r["nth"]] = r["page"]
    want = {i: p + 1 for i, p in enumerate(relational.seeded_places(30, 42)[:5])}
    assert got["a"] == got["b"] == got[None] == want and sorted(got["few"].values()) == [3, 8]
    assert relational.seeded_sample(df.limit(0), ["g"], "page", 5, 42).count() == 0


def test_rows_kept_by_group(spark):
    rows = [(i % 7 if i % 7 else None, i, dt.datetime(2024, 1, 1), [i], f"t{i % 3}") for i in range(5_000)]
    df = spark.createDataFrame(rows, "k int, i int, at timestamp, list array<int>, t string").select("i", "k", "at", "list", "t")
    got = kernels.keep_rows(df, ["k"], ["i"], ["t"], lambda g: [x not in g["t"][:j] for j, x in enumerate(g["t"])])
    assert got.columns == df.columns and got.schema == df.schema
    first = {}
    for k, i, *_, t in rows:
        first.setdefault((k, t), i)
    assert sorted(r["i"] for r in got.collect()) == sorted(first.values())
