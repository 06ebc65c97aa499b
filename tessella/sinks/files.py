"""Writers. All of them go through Spark's own sinks, part by part; nothing is gathered but what a single file must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.labels import CANONICAL
from tessella.functions.text import csv_safe


def write_csv(df: DataFrame, path: str, guard: bool = False, mode: str = "overwrite") -> None:
    """Header, double quotes doubled, quotes only where needed; guard: cells that start a formula get a quote before."""
    df = df.select(*[csv_safe(F.col(c)).alias(c) for c in df.columns]) if guard else df
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_sections(sections: dict[str, DataFrame], path: str, guard: bool = False) -> None:
    """A folder of delimited files for each headed block."""
    for name, df in sections.items():
        write_csv(df, f"{path}/{name}", guard)


def _cell(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_line(columns: list[str], guard: bool = False) -> Column:
    """A row's columns as a delimited line, quoted on comma, quote and line feed only."""
    return F.concat_ws(",", *[_cell(csv_safe(F.col(c)) if guard else F.col(c)) for c in columns])


def csv_lines(df: DataFrame, guard: bool = False) -> DataFrame:
    """One column `value`: rows as lines of csv_line()."""
    return df.select(csv_line(df.columns, guard).alias("value"))


def write_label_files(lines: DataFrame, path: str) -> None:
    """Label lines by split; lines: split, run_id, page_number, line. One text folder for each split and page."""
    text = lines.repartition("split", "run_id", "page_number").select("split", "run_id", "page_number", F.col("line").alias("value"))
    text.write.mode("overwrite").partitionBy("split", "run_id", "page_number").text(f"{path}/labels")


def data_sheet(spark, path: str) -> DataFrame:
    """The data sheet of label files: folders of the splits and names of the classes."""
    head = [f"path: {path}", *[f"{s}: labels/split={s}" for s in ("train", "val", "test")], f"nc: {len(CANONICAL)}", "names:"]
    return spark.createDataFrame([("\n".join([*head, *[f"  {i}: {c}" for i, c in enumerate(CANONICAL)]]),)], "value string")


def snapshot(df: DataFrame, key: str, as_of: str) -> DataFrame:
    """key, as_of, snapshot: the other columns of each row as JSON."""
    return df.select(key, F.lit(as_of).alias("as_of"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("snapshot"))


def archive_rows(df: DataFrame, table: str, path: str) -> None:
    """Appends rows as JSON with the name of their table, before they are deleted."""
    df.select(F.lit(table).alias("table_name"), F.to_json(F.struct("*")).alias("row")).write.mode("append").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """The partitions that df has rows for are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def upsert_table(spark, changes: DataFrame, path: str, keys: list[str], version: str) -> str:
    """Writes base and changes as a new version beside the old one and returns its place: readers of the old one aren't disturbed."""
    from tessella.operators.relational import upsert

    base = spark.read.parquet(path)
    new = f"{path.rstrip('/')}-{version}"
    upsert(base, changes, keys).write.mode("errorifexists").parquet(new)
    return new


#: Columns of the lineage of zones, by the names of its file.
LINEAGE = {
    "runId": "run_id", "documentName": "document", "completedAt": "completed_at", "pageNumber": "page_number", "zoneId": "zone_id", "zoneIndex": "zone_index", "doclingLabel": "a_label", "pdfxtLabel": "b_label",
    "reconciliationBucket": "bucket", "aiDecision": "ai_decision", "aiLabel": "ai_label", "aiConfidence": "ai_confidence", "humanDecision": "decision", "humanLabel": "human_label", "verifiedBy": "verified_by", "finalLabel": "final_label",
}


def lineage_lines(zones: DataFrame) -> DataFrame:
    """completed_at, run_id, zone_index, value: the delimited line of each zone of lineage(), cells that start a formula guarded;
    sorted by the first three they are the file's lines below its header, which is the keys of LINEAGE."""
    sure = F.col("ai_confidence")
    shown = zones.withColumn("ai_confidence", F.when(sure.isNotNull(), F.format_string("%.3f", sure)))
    return shown.select("completed_at", "run_id", "zone_index", csv_line(list(LINEAGE.values()), guard=True).alias("value"))


def write_lineage(zones: DataFrame, path: str) -> None:
    """The lines by runs in order of their completion, in parts whose names sort like the lines, each with the header."""
    sorted_lines = lineage_lines(zones).orderBy("completed_at", "run_id", "zone_index")
    sorted_lines.select(F.col("value").alias(",".join(LINEAGE))).write.mode("overwrite").csv(path, header=True, quote="", escapeQuotes=False, sep="\u0001")
