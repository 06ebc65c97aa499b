"""A corpus from raw documents to packed sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import common, digest_index, packing, pii, quality_rules, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them; an empty table stays empty, as in every stage."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, of repeated rows one; null texts count as empty."""
    return digest_index.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, a similarity of 0.8. Texts without words
    have no partner; rows of one doc_id stay or go together."""
    return simhash.keep_one_similar(docs, similarity=0.8, width=5)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind; null texts stay null, rows of one doc_id share discovered tokens."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: where it lies in which sequence. A null text is an empty one, of one closing id."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("personal", personal), ("packed", packed)]

#: SQL can't grow the forest, look through an index or pack: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return common.materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
