"""Sharding by jump consistent hashing: no ring table; one more shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Parts of a shard that are numbered apart, so that no task holds a whole shard.
PARTS = 256


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key: jumps ahead by pseudo-random steps until one passes the last shard."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = keys.astype(np.uint64).copy()
    at = np.zeros(len(key), np.int64)
    to = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = to[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        to[live] = ((at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[to[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Column of shards for a column of stable keys of any type; null is a key like any other."""

    @F.pandas_udf("int")
    def jump(h: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(h.to_numpy(np.int64).view(np.uint64), shards))

    return jump(F.xxhash64(key))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32 (null for a null text's row: that of the empty text), law, shard, slot, grown_shard.

    Law `key`: doc_id and the shard count decide, so rows of one doc_id share a shard. Slots number a shard's
    rows without gaps: each of `parts` parts of a shard is numbered alone and starts where the parts before it end;
    the table of starts has at most shards * parts rows. Repeated rows and null ids get slots of their own.
    """
    common.ship(docs.sparkSession)
    text = common.text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        shard_of(F.col(id_col), shards).alias("shard"),
        shard_of(F.col(id_col), shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = common.materialize(rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")), "shards")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "row"))
    return (
        rows.withColumn("nth", within)
        .join(F.broadcast(starts), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard")
    )
