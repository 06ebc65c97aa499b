"""Exact deduplication over a persistent digest index, bucketed and sorted by hash.

Texts are equal when identical after deleting blanks and U+0009 to U+000D. New data is held against
the index by a sort-merge anti-join; digests not yet there are appended.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A group of over one in so many of all rows is joined by broadcast: there are fewer than that, whatever the input.
HOT = 1000


def normalised(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), " \t\n\x0b\f\r", text)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """A Parquet table at `path`, CLUSTERED BY and SORTED BY digest. Any session can open it again; appends add files to its buckets.

    buckets: as many as shuffles have partitions where not given; a bucket is what one task holds of the index, so their
    number should grow with it. It and the type of ids are settled when the index is made and read from it later.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path = spark, path
        layout = f"{path}/_layout"  # Spark takes no folder of such a name for data
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(layout)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            self.buckets, self.id_type = spark.read.schema("buckets int, id_type string").json(layout).first()
        else:
            self.buckets, self.id_type = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), id_type
            spark.createDataFrame([(self.buckets, id_type)], "buckets int, id_type string").coalesce(1).write.json(layout)
        self.table = f"digest_index_{uuid.uuid4().hex}"
        columns = f"digest binary, keep_id {self.id_type}, batch string"
        spark.sql(f"CREATE TABLE {self.table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def absent(self, groups: DataFrame) -> DataFrame:
        """The rows of groups whose digest the index lacks. The index side isn't shuffled."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def known(self, groups: DataFrame) -> DataFrame:
        """groups with keep_id and batch of the index for their digests. The index side isn't shuffled."""
        return groups.join(self.read().hint("merge"), "digest")

    def few(self, digests: list[bytes]) -> DataFrame:
        """The index rows of these digests, out of their buckets alone."""
        return self.read().where(F.col("digest").isin(digests))

    def append(self, rows: DataFrame) -> None:
        rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").write.insertInto(self.table)

    def close(self) -> None:
        """Forgets the name; the files stay, and so do frames that read them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256; the index then holds every digest.

    Of equal texts new to the index the row with the most code points stays, then the smallest doc_id (null ids
    last), then one of the repeated rows. Texts that the index knows already all go, their keep_id is the indexed one.
    group_size counts the rows of docs. Copies of a text with over a thousandth of all rows find their group by
    broadcast, so none gathers in one task. Null text counts as empty, and empty texts are equal. Ids are of any type
    that sorts, that of the index. batch: the caller's name for these docs. The index is written when this is called;
    if the result is lost, the same docs under the same name give it again, as what a batch has put in is new to itself.
    """
    batch = batch or uuid.uuid4().hex
    rows, groups = _register(docs, index, id_col, text_col, batch)
    groups = groups.drop("keep_id")
    share = rows.count() / HOT
    hot = [bytes(r[0]) for r in groups.where(F.col("group_size") > share).select("digest").collect()]

    def verdict(known: DataFrame) -> DataFrame:
        return known.select("digest", "group_size", "keep_id", F.when(F.col("batch") == batch, F.col("keep_row")).alias("keep_row"))

    is_hot = F.col("digest").isin(hot)
    joined = rows.where(~is_hot).join(verdict(index.known(groups.where(~is_hot))), "digest")
    if hot:
        joined = joined.unionByName(rows.where(is_hot).join(F.broadcast(verdict(groups.where(is_hot).join(F.broadcast(index.few(hot)), "digest"))), "digest"))
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _register(docs: DataFrame, index: DigestIndex, id_col: str, text_col: str, batch: str) -> tuple[DataFrame, DataFrame]:
    """rows(doc_id, row, chars, digest) and groups(digest, group_size, keep_id, keep_row); what is new is in the index afterwards."""
    text = common.text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.char_length(text).cast("long").alias("chars"), digest(text).alias("digest"))
    rows = common.materialize(rows, "digests")
    best = F.min(F.struct((-F.col("chars")).alias("least"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row"))
    groups = rows.groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("best"))
    groups = common.materialize(groups.select("digest", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")), "groups")
    index.append(index.absent(groups).withColumn("batch", F.lit(batch)))
    return rows, groups


def keep_first(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, all columns as they were: the winners of deduplicate(), one of each repeated row.

    Null texts count as empty; an empty table stays empty.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, common.scratch_path(spark, "index"), id_type=docs.schema[id_col].dataType.simpleString())
    batch = batch or uuid.uuid4().hex
    rows, groups = _register(docs, index, id_col, text_col, batch)
    d, i, n = (common.fresh(docs, x) for x in ("tess_digest", "tess_id", "tess_nth"))
    won = index.known(groups.drop("keep_id")).where(F.col("batch") == batch).select("digest", "keep_row")
    # How many rows of the winner's text and id there are: one, but for repeated rows.
    mine = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("chars")).alias("least"), "row"))["row"].alias("row"))
    mine = mine.join(won, (mine["digest"] == won["digest"]) & (mine["row"] == won["keep_row"]), "left_semi")
    mine = common.materialize(mine.select(F.col("digest").alias(d), F.col("doc_id").alias(i), "n"), "winners")
    index.close()
    marked = docs.withColumn(d, digest(common.text_of(text_col)))

    def same(won: DataFrame) -> Column:
        return (marked[d] == won[d]) & marked[id_col].eqNullSafe(won[i])

    once, often = mine.where("n = 1"), mine.where("n > 1")
    out = marked.join(once, same(once), "left_semi")
    if not often.isEmpty():
        nth = F.row_number().over(Window.partitionBy(d, id_col).orderBy(F.char_length(common.text_of(text_col)).desc()))
        out = out.unionByName(marked.join(often, same(often), "left_semi").withColumn(n, nth).where(F.col(n) == 1).drop(n))
    return out.select(*docs.columns)
