"""Reports of three blocks in one file, as plain Python would lay them out."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.sinks import blocks


def test_one_file(spark, tmp_path):
    rows = [(i, f'x,{i}' if i % 3 else f'say "{i}"') for i in range(5000)]
    one = spark.createDataFrame(rows[::-1], "id long, text string").repartition(7)
    none = spark.createDataFrame([], "page int, place string")
    last = spark.createDataFrame([(2, "=b"), (1, None)], "k int, nth string")
    path = str(tmp_path / "deep" / "report.csv")
    os.makedirs(os.path.dirname(path))
    report = [("One", one, ["id"]), ("Pages", none, ["page"]), ("Types", last, ["k"])]
    blocks.write_report(report, path, guard=True)
    body = [f'{i},"{t.replace(chr(34), chr(34) * 2)}"' for i, t in rows]
    want = ["# One", "id,text", *body, "", "# Pages", "page,place", "", "# Types", "k,nth", "1,", "2,'=b"]
    assert open(path).read() == "\n".join(want) + "\n"
    assert os.listdir(os.path.dirname(path)) == ["report.csv"]
    blocks.write_report(report[2:], f"file:{path}")
    assert open(path).read() == "# Types\nk,nth\n1,\n2,=b\n"
    with pytest.raises(Exception, match="there already"):
        blocks.write_report(report, path, overwrite=False)
    with pytest.raises(Exception, match="rows must be"):
        last.write.format("one_file").mode("overwrite").save(path)
    assert open(path).read() == "# Types\nk,nth\n1,\n2,=b\n"


def test_attempts_that_do_not_count(tmp_path):
    path = str(tmp_path / "r.csv")
    writer = blocks.BlockWriter(path, True)

    def rows(*values):
        return iter([pa.record_batch([pa.array([b for b, _ in values], pa.int32()), pa.array([v for _, v in values])], ["block", "value"])])

    def dies():
        yield from rows((0, "a"), (1, "half"))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    writer.write(rows((0, "a"), (1, "b")))  # an attempt whose message never comes
    writer.commit([writer.write(rows((0, "a"), (1, "b"), (1, None))), None])
    assert open(path).read() == "a\nb\n\n" and os.listdir(tmp_path) == ["r.csv"]
    other = blocks.BlockWriter(path, True)
    other.write(rows((0, "new")))
    other.abort([])
    assert open(path).read() == "a\nb\n\n" and os.listdir(tmp_path) == ["r.csv"]


def test_failed_job_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    good = spark.range(3)
    blocks.write_report([("A", good, ["id"])], path)
    bad = good.select(F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("v"), "id")
    with pytest.raises(Exception):
        blocks.write_report([("A", bad, ["id"])], path)
    assert open(path).read() == "# A\nid\n0\n1\n2\n"
