"""The query surface of a record store: optional filters, pages, upserts, snapshots, set operations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.kernels import per_group

MAX_PAGE, MAX_LIMIT, DEFAULT_LIMIT = 1000, 200, 50


def where_given(df: DataFrame, **equal) -> DataFrame:
    """Equality on the columns whose value is given; None means no filter."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in equal.items() if v is not None), df)


def contains_any_case(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows in which one of the columns contains the text, in any case; no wildcard means anything."""
    return df.where(reduce(lambda a, b: a | b, [F.lower(c).contains(text.lower()) for c in columns]))


def between(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Inclusive ends, each optional."""
    df = df if low is None else df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) <= high)


def page_of(df: DataFrame, order: list[Column], page: int = 1, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One page: page from 1 to 1000, limit from 1 to 200."""
    page, limit = min(max(page, 1), MAX_PAGE), min(max(limit, 1), MAX_LIMIT)
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def page_count(df: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """total, pages."""
    return df.agg(F.count("*").alias("total"), F.ceil(F.count("*") / F.lit(min(max(limit, 1), MAX_LIMIT))).alias("pages"))


def page_after(df: DataFrame, time: str, key: str, cursor: tuple | None, limit: int) -> DataFrame:
    """Newest first, after the cursor (time, key); one row more than limit tells that there is a next page. No offset is walked."""
    if cursor is not None:
        t, k = (F.lit(c) for c in cursor)
        df = df.where((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < k)))
    return df.orderBy(F.desc(time), F.desc(key)).limit(limit + 1)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    n = "_row_of_key"
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """changes replace rows of base that have their key, and are added where none has."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*base.columns))


def update_where(df: DataFrame, condition: Column, **values) -> DataFrame:
    return df.withColumns({k: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def replace_group(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Delete, then insert: all rows of the keys in new give way to new."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def change_log(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, change: added, removed or changed; rows that are alike, nulls included, don't appear."""
    a = before.select(F.col(key).alias("_a"), F.struct(*columns).alias("_was"))
    b = after.select(F.col(key).alias("_b"), F.struct(*columns).alias("_is"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_was").eqNullSafe(F.col("_is")), "changed")
    return both.select(F.coalesce("_a", "_b").alias(key), change.alias("change")).where("change IS NOT NULL")


def backfill(df: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """Nulls of a column from another table's."""
    s = source.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    return df.join(s, df[key] == s["_k"], "left").withColumn(column, F.coalesce(column, "_v")).drop("_k", "_v")


def dense_counts(df: DataFrame, domain: DataFrame, key: str) -> DataFrame:
    """Counts over a fixed domain, zeros included."""
    return domain.join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").fillna(0, ["n"])


def top_groups(df: DataFrame, keys: list[str], limit: int = 10) -> DataFrame:
    """The most frequent groups; ties by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(limit)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def numbers_between(df: DataFrame, low: Column, high: Column, name: str, step: int = 65_536) -> DataFrame:
    """df + name: a row for each number from low to high, both included, none where high is lower or a bound is null.

    Numbers come in stretches of `step`, so a wide span is never one array: of a billion it makes arrays of 65,536.
    """
    wide = df.withColumns({"_low": low.cast("long"), "_high": high.cast("long")}).where("_low <= _high")
    cut = wide.withColumn("_from", F.explode(F.sequence("_low", "_high", F.lit(step).cast("long"))))
    each = F.explode(F.sequence("_from", F.least(F.col("_from") + (step - 1), "_high")))
    return cut.withColumn(name, each).drop("_low", "_high", "_from")


def missing_numbers(df: DataFrame, keys: list[str], number: str, last: str) -> DataFrame:
    """keys, number of 1..last that a group lacks; a group whose last is below 1 or null lacks none."""
    spans = df.groupBy(*keys).agg(F.max(last).alias("_last"))
    every = numbers_between(spans, F.lit(1), F.col("_last"), number).select(*keys, number)
    return every.join(df.select(*keys, F.col(number).cast("long").alias(number)).distinct(), [*keys, number], "left_anti")


def next_numbers(new: DataFrame, base: DataFrame, key: str, number: str, order: list[str]) -> DataFrame:
    """new rows numbered from the highest number of their key on."""
    top = base.groupBy(key).agg(F.max(number).alias("_top"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.join(top, key, "left").withColumn(number, F.coalesce("_top", F.lit(0)) + nth).drop("_top")


def last_before(points: DataFrame, marks: DataFrame, keys: list[str], at: str, start: str, columns: list[str], cell: int) -> DataFrame:
    """points + columns of the mark of equal keys with the highest start that isn't above at; of equal starts the one of the
    highest columns. Null where there is none, or where a key or at is null.

    For stretches that each end where the next begins, this is the join on start <= at < next start, without its pairs. Both
    sides are cut into cells of that width; each cell gets the last mark before it, so a task sorts cells, not whole keys.
    """

    def cell_of(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(cell)).cast("long")

    by_cell, order = [*keys, "_cell"], ["_at", "_kind", "_mark"]
    here = [F.col(c).isNotNull() for c in [*keys, start]]
    found = marks.where(reduce(lambda a, b: a & b, here)).select(*keys, cell_of(start).alias("_cell"), F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.struct(*columns).alias("_mark"))
    asked = points.select(*keys, cell_of(at).alias("_cell"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_point"))
    ends = found.groupBy(*by_cell).agg(F.max(F.struct("_at", "_mark"))["_mark"].alias("_mark"))
    cells = ends.unionByName(asked.select(*by_cell).distinct(), allowMissingColumns=True).groupBy(*by_cell).agg(F.max("_mark").alias("_mark"))
    earlier = F.last("_mark", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    carried = cells.withColumn("_mark", earlier).where("_mark IS NOT NULL AND _cell IS NOT NULL").withColumn("_kind", F.lit(0))  # a null place sorts first
    rows = asked.unionByName(found, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    last = F.last("_mark", ignorenulls=True).over(Window.partitionBy(*by_cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_mark", last).where("_kind = 1").select("_point.*", *[F.col("_mark")[c].alias(c) for c in columns])


def sample_rows(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows that depend on keys and seed alone, by hash order."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def _uniform(seed: int) -> Iterator[float]:
    """The public generator mulberry32: fractions of 2^32."""
    whole = 0xFFFFFFFF
    state = seed & whole
    while True:
        state = (state + 0x6D2B79F5) & whole
        t = (state ^ state >> 15) * (state | 1) & whole
        t = (t + (t ^ t >> 7) * (t | 61) & whole) ^ t
        yield (t ^ t >> 14) / 2**32


def seeded_places(n: int, seed: int) -> list[int]:
    """0..n-1 in the order that the generator's shuffle gives them: from the last place down, each swapped with one not after it."""
    places, draws = list(range(n)), _uniform(seed)
    for i, u in zip(range(n - 1, 0, -1), draws, strict=False):
        j = int(u * (i + 1))
        places[i], places[j] = places[j], places[i]
    return places


def seeded_sample(df: DataFrame, keys: list[str], item: str, n: int, seed: int, most: int | None = None) -> DataFrame:
    """keys, item, nth: n of each group's distinct items as the seeded shuffle of the sorted items draws them, nth from 0.

    most: items above it aren't drawn. Null items are none; a group with n items or fewer gives all of them. What is drawn
    depends on the group's items and the seed alone, not on how rows are dealt. A group's distinct items (the pages of
    a document) are held at once.
    """
    kept = df.where(F.col(item).isNotNull() if most is None else F.col(item) <= most).select(*keys, F.col(item).cast("long").alias(item)).distinct()

    def draw(g: dict) -> dict:
        chosen = seeded_places(len(g[item]), seed)[:n]
        return {item: g[item][chosen], "nth": np.arange(len(chosen), dtype=np.int64)}

    return per_group(kept, keys, [item], [item], draw, {item: "bigint", "nth": "bigint"})
