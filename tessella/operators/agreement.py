"""Agreement of reviewers, machines and extractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.labels import by_machine, confidence_bin
from tessella.functions.numbers import half_up, pct, rate


def grouped_accuracy(rows: DataFrame, key: Column, agrees: Column) -> DataFrame:
    """key, agree, total, rate."""
    hit = agrees.cast("int")
    return rows.groupBy(key.alias("key")).agg(F.sum(hit).alias("agree"), F.count("*").alias("total"), F.avg(hit).alias("rate"))


def cohens_kappa(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, n, po, kappa: agreement beyond chance; null under two rows; where chance alone explains all, 1 if all agree, else 0.

    Marginals come from one count of label pairs, so only as many rows as there are pairs of labels are joined.
    """
    pairs = rows.groupBy(*keys, a, b).agg(F.count("*").alias("k"))
    total = pairs.groupBy(*keys).agg(F.sum("k").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("k")).otherwise(0)).alias("same"))
    left = pairs.groupBy(*keys, F.col(a).alias("label")).agg(F.sum("k").alias("ka"))
    right = pairs.groupBy(*keys, F.col(b).alias("label")).agg(F.sum("k").alias("kb"))
    chance = left.join(right, [*keys, "label"]).groupBy(*keys).agg(F.sum(F.col("ka") * F.col("kb")).alias("kk"))
    out = total.join(chance, keys, "left") if keys else total.crossJoin(chance)
    po, pe = F.col("same") / F.col("n"), F.coalesce(F.col("kk"), F.lit(0)) / (F.col("n") * F.col("n"))
    kappa = F.when(F.col("n") >= 2, F.when(pe >= 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe)))
    return out.select(*keys, "n", po.alias("po"), kappa.alias("kappa"))


def confidence_calibration(rows: DataFrame, confidence: Column, agrees: Column) -> DataFrame:
    """bucket, predicted, actual (3 decimals), count; empty bins don't appear."""
    binned = rows.select(confidence_bin(confidence).alias("bucket"), confidence.alias("c"), agrees.cast("int").alias("ok")).where("bucket IS NOT NULL")
    return binned.groupBy("bucket").agg(half_up(F.avg("c"), 3).alias("predicted"), half_up(F.avg("ok"), 3).alias("actual"), F.count("*").alias("count"))


def common_mistakes(rows: DataFrame, was: Column, should: Column, limit: int = 20) -> DataFrame:
    """The most frequent disagreements; ties by name."""
    return rows.select(was.alias("from_label"), should.alias("to_label")).where("from_label <> to_label").groupBy("from_label", "to_label").count().orderBy(F.desc("count"), "from_label", "to_label").limit(limit)


def confusion_matrix(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """a_label, b_label, n for every pair of labels that occur on either side, zeros included.

    The labels of both sides, a small domain, are crossed with each other; rows are counted first.
    """
    counts = rows.select(a.alias("a_label"), b.alias("b_label")).where("a_label IS NOT NULL AND b_label IS NOT NULL").groupBy("a_label", "b_label").agg(F.count("*").alias("n"))
    labels = counts.select(F.explode(F.array("a_label", "b_label")).alias("label")).distinct()
    grid = labels.select(F.col("label").alias("a_label")).crossJoin(labels.select(F.col("label").alias("b_label")))
    return grid.join(counts, ["a_label", "b_label"], "left").fillna(0, ["n"])


def headline(zones: DataFrame) -> DataFrame:
    """One row: agreement of machine and human labels; corrected and rejected shares of human decisions."""
    human = ~by_machine(F.col("verified_by"))
    both = F.col("ai_label").isNotNull() & F.col("human_label").isNotNull()
    decided = F.col("decision").isNotNull() & human

    def n(c: Column) -> Column:
        return F.count_if(c)

    return zones.agg(
        F.count("*").alias("total_zones"),
        rate(n(both & (F.col("ai_label") == F.col("human_label"))), n(both)).alias("ai_agreement_rate"),
        rate(n(decided & (F.col("decision") == "CORRECTED")), n(decided)).alias("human_correction_rate"),
        rate(n(decided & (F.col("decision") == "REJECTED")), n(decided)).alias("human_rejection_rate"),
    )


def per_zone_type(zones: DataFrame) -> DataFrame:
    """zone_type, totals, shares of machine decisions, the label that humans most often correct to (ties: the first by name)."""
    kind = F.coalesce(F.nullif(F.col("zone_type"), F.lit("")), F.lit("unknown")).alias("zone_type")
    n = F.count("*")
    shares = [pct(F.count_if(F.col("ai_decision") == d), n).alias(f"ai_{name}_pct") for d, name in (("CONFIRMED", "confirm"), ("CORRECTED", "correction"), ("REJECTED", "rejection"))]
    totals = zones.groupBy(kind).agg(n.alias("total_zones"), *shares)
    to = zones.where((F.col("decision") == "CORRECTED") & F.col("operator_label").isNotNull() & ~by_machine(F.col("verified_by"))).groupBy(kind, "operator_label").count()
    top = to.withColumn("r", F.row_number().over(Window.partitionBy("zone_type").orderBy(F.desc("count"), "operator_label"))).where("r = 1").select("zone_type", F.col("operator_label").alias("top_corrected_to"))
    return totals.join(top, "zone_type", "left")


def bucket_flow(zones: DataFrame) -> DataFrame:
    """bucket, total and human decisions of GREEN, AMBER and RED, zeros included."""
    human = ~by_machine(F.col("verified_by"))
    cols = [F.count_if(human & (F.col("decision") == d)).alias(f"human_{d.lower()}") for d in ("CONFIRMED", "CORRECTED", "REJECTED")]
    counted = zones.where(F.col("bucket").isin("GREEN", "AMBER", "RED")).groupBy("bucket").agg(F.count("*").alias("total"), *cols)
    domain = zones.sparkSession.createDataFrame([("GREEN",), ("AMBER",), ("RED",)], "bucket string")
    return domain.join(counted, "bucket", "left").fillna(0)


def extractor_disagreement(zones: DataFrame) -> DataFrame:
    """Share of regions whose two extractors differ, by human label; both extractors must have one."""
    both = zones.where("human_label IS NOT NULL AND a_label IS NOT NULL AND b_label IS NOT NULL")
    n = F.count("*")
    return both.groupBy(F.col("human_label").alias("final_label")).agg(n.alias("total_zones"), pct(F.count_if(F.col("a_label") != F.col("b_label")), n).alias("disagreement_pct"))


def weighted_mean(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """Mean of non-null values by weight; null if there is no weight."""
    return rows.where(F.col(value).isNotNull()).agg(rate(F.sum(F.col(value) * F.col(weight)), F.sum(weight), empty=None).alias("value"))
