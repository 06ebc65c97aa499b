"""Grouped kernels: numpy functions over sorted groups, many small groups to a batch.

applyInPandas pays a data frame for each group, milliseconds where groups are tens of rows. Here rows are dealt and
sorted by key once, and each task walks its groups in Arrow batches; a group that crosses batches is carried over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Columns = dict[str, np.ndarray]


def _starts(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Rows at which a key changes, the first included."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for i in range(n_keys):
        codes = batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _walk(batches: Iterable[pa.RecordBatch], n_keys: int, done: Callable[[pa.RecordBatch, np.ndarray, int], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What done(batch, starts, end) gives for whole groups; the last group of a batch waits for the next one."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if kept:
            batch = pa.Table.from_batches([*kept, batch]).combine_chunks().to_batches()[0]
        starts = _starts(batch, n_keys)
        if len(starts) > 1:
            yield from done(batch.slice(0, starts[-1]), starts[:-1], int(starts[-1]))
        kept = [batch.slice(int(starts[-1]))]
    for batch in kept:
        yield from done(batch, np.array([0]), batch.num_rows)


def per_group(df: DataFrame, keys: list[str], order: list[str], columns: list[str], kernel: Callable[[Columns], Columns], out: dict[str, str]) -> DataFrame:
    """keys + out columns: kernel gets each group's columns, sorted by order, and gives arrays of one length.

    out: name -> Spark type. Groups must fit into memory, as with applyInPandas; null keys are a group.
    """
    names = [*dict.fromkeys([*keys, *columns])]
    fields = [*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], *[f"`{k}` {t}" for k, t in out.items()]]
    schema = ", ".join(fields)
    kinds = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

    def done(batch: pa.RecordBatch, starts: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        whole = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
        rows: list[np.ndarray] = []
        made: dict[str, list] = {k: [] for k in out}
        for a, b in zip(starts, [*starts[1:], end], strict=True):
            got = kernel({n: v[a:b] for n, v in whole.items()})
            size = len(next(iter(got.values())))
            rows.append(np.full(size, a))
            for k in out:
                made[k].append(got[k])
        if rows:
            at = pa.array(np.concatenate(rows))
            cols = [batch.column(i).take(at) for i in range(len(keys))]
            cols += [pa.array(np.concatenate(made[k]), kinds[out[k]]) for k in out]
            yield pa.record_batch(cols, [*keys, *out])

    dealt = df.select(*names, *[c for c in order if c not in names]).repartition(*keys).sortWithinPartitions(*keys, *order).select(*names)
    return dealt.mapInArrow(lambda batches: _walk(batches, len(keys), done), schema)


def keep_rows(df: DataFrame, keys: list[str], order: list[str], columns: list[str], kernel: Callable[[dict[str, list]], list[bool]]) -> DataFrame:
    """The rows of df that kernel keeps; it gets lists of a group's columns, sorted by order, and says for each row whether it stays.

    All columns go through untouched, of whatever type. Groups must fit into memory; null keys are a group.
    """
    names = [*keys, *[c for c in df.columns if c not in keys]]

    def done(batch: pa.RecordBatch, starts: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        whole = {c: batch.column(names.index(c)).to_pylist() for c in columns}
        mask: list[bool] = []
        for a, b in zip(starts, [*starts[1:], end], strict=True):
            mask += kernel({c: v[a:b] for c, v in whole.items()})
        if mask:
            yield batch.slice(0, end).filter(pa.array(mask, pa.bool_()))

    dealt = df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(lambda batches: _walk(batches, len(keys), done), dealt.schema).select(*df.columns)
