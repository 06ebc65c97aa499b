"""Reports of headed blocks in one file: a data source whose tasks write pieces and whose commit lays them end to end.

    blocks.write_report([("Operators", operators, ["operator_id"]), ("Pages", pages, ["page"])], "s3://reports/run-1.csv")

Rows are sorted and written by tasks; the driver only copies bytes, in pieces of 8 MB. Commit names the pieces of the
attempts that count, so those of failed or repeated attempts never reach the file, and the file appears when it is whole.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessella.sinks.files import csv_line

COPIED = 8 << 20


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


@dataclass
class Pieces(WriterCommitMessage):
    """Pieces of one attempt: block, task, name."""

    names: list[tuple[int, int, str]]


class BlockWriter(DataSourceArrowWriter):
    """Writes rows (block, value) as lines, a piece for each task and stretch of a block."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.folder = path, f"{path}.parts-{uuid.uuid4().hex}"
        fs, place = _place(path)
        if not overwrite and fs.get_file_info(place).type != pyarrow.fs.FileType.NotFound:
            raise ValueError(f"{path} is there already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pieces:
        fs, folder = _place(self.folder)
        fs.create_dir(folder, recursive=True)
        context = TaskContext.get()
        task, attempt = context.partitionId() if context else 0, uuid.uuid4().hex
        names, out, at = [], None, None
        for batch in iterator:
            for block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None or block != at:
                    if out is not None:
                        out.close()
                    names.append((block, task, f"{task}-{attempt}-{len(names)}"))
                    out, at = fs.open_output_stream(f"{folder}/{names[-1][2]}"), block
                out.write(((value or "") + "\n").encode())
        if out is not None:
            out.close()
        return Pieces(names)

    def commit(self, messages: list[Pieces | None]) -> None:
        fs, folder = _place(self.folder)
        _, place = _place(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/whole") as out:
            for _, _, name in sorted((p for m in messages if m for p in m.names), key=lambda p: p[:2]):
                with fs.open_input_stream(f"{folder}/{name}") as piece:
                    while data := piece.read(COPIED):
                        out.write(data)
        fs.move(f"{folder}/whole", place)
        fs.delete_dir(folder)

    def abort(self, messages: list[Pieces | None]) -> None:
        fs, folder = _place(self.folder)
        if fs.get_file_info(folder).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(folder)


class OneFile(DataSource):
    """`df.write.format("one_file").save(path)`; df: block int, value string, in the order of the lines."""

    @classmethod
    def name(cls) -> str:
        return "one_file"

    def schema(self) -> str:
        return "block int, value string"

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        if schema.simpleString() != "struct<block:int,value:string>":
            raise ValueError(f"rows must be block int, value string, not {schema.simpleString()}")
        return BlockWriter(self.options["path"], overwrite)


def report_lines(blocks: list[tuple[str, DataFrame, list[str]]], guard: bool = False) -> DataFrame:
    """block, value, sorted: of each (title, rows, order) a line `# title`, the names of the columns, the rows as
    delimited lines by `order`, then an empty line unless it is the last block. A block without rows keeps its two lines."""
    parts = []
    for n, (title, df, order) in enumerate(blocks):
        make = df.sparkSession.createDataFrame
        parts.append(make([(n, f"# {title}"), (n, ",".join(df.columns))], "block int, value string").coalesce(1))
        parts.append(df.orderBy(*order).select(F.lit(n).alias("block"), csv_line(df.columns, guard).alias("value")))
        if n < len(blocks) - 1:
            parts.append(make([(n, "")], "block int, value string").coalesce(1))
    return reduce(DataFrame.unionByName, parts)  # a union keeps its inputs' partitions one after the other


def write_report(blocks: list[tuple[str, DataFrame, list[str]]], path: str, guard: bool = False, overwrite: bool = True) -> None:
    """Writes report_lines() as the one file `path`, on any store that Arrow reaches; with overwrite=False it must be new."""
    spark = blocks[0][1].sparkSession
    spark.dataSource.register(OneFile)
    report_lines(blocks, guard).write.format("one_file").mode("overwrite" if overwrite else "append").save(path)
