"""Numbering all rows of a table without moving them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def _below(marks: str, value: Column) -> Column:
    """How many marks are below the value; none are below a null, which sorts first."""
    return F.coalesce(F.size(F.filter(marks, lambda m: m < value)), F.lit(0))


def parts(df: DataFrame, order: list[str], ranges: int = 64) -> DataFrame:
    """df + _range, _part: where rows of a later pair come after those of an earlier one by the first two columns of order.

    Ranges are cut at quantiles of the first column; a value on which several quantiles fall is a part of its own, cut again
    at the quantiles of the second column where that is a number. There are at most ranges x (ranges + 1) parts, whatever
    the table's size. Rows equal in both columns share a part, as do rows whose first column is null.
    """
    points = [i / ranges for i in range(1, ranges)]
    first = F.col(order[0])
    marks = df.agg(F.percentile_approx(first, points).alias("_marks"))
    hot = F.size(F.filter("_marks", lambda m: m == first)) > 1
    cut = df.crossJoin(F.broadcast(marks)).withColumns({"_range": _below("_marks", first), "_part": F.when(hot, 1).otherwise(0)}).drop("_marks")
    if len(order) == 1 or not isinstance(df.schema[order[1]].dataType, NumericType):
        return cut
    second = F.col(order[1])
    finer = cut.where("_part = 1").groupBy("_range", "_part").agg(F.percentile_approx(second, points).alias("_finer"))
    cut = cut.join(F.broadcast(finer), ["_range", "_part"], "left")
    return cut.withColumn("_part", F.when(F.col("_part") == 1, 1 + _below("_finer", second)).otherwise(0)).drop("_finer")


def global_row_number(df: DataFrame, order: list[str], name: str = "row_number", ranges: int = 64) -> DataFrame:
    """df + a number from 1 by `order`: each of parts() is numbered alone and starts where those before it end. Only the parts'
    starts are broadcast."""
    cut = parts(df, order, ranges)
    counts = cut.groupBy("_range", "_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_range", "_part").orderBy(*order))
    placed = cut.withColumn("_nth", nth).join(F.broadcast(starts), ["_range", "_part"])
    return placed.select(*df.columns, (F.col("_start") + F.col("_nth")).alias(name))
