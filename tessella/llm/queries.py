"""The operators of this subpackage as queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, digest_index, lexical_search, line_dedup, packing, periodic, pii, quality_rules, sharding, simhash, token_counts, toxicity, weak_quality


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir))


def op3_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score (probability of good), kept. No labels are read."""
    return weak_quality.classify(_documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), 24)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, clean_sha256 (of the cleaned text)."""
    return line_dedup.remove_boilerplate(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("clean_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir), width=3, bits=2)
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(_documents(spark, sf_dir)))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table against an empty index."""
    docs = _documents(spark, sf_dir)
    index = digest_index.DigestIndex(spark, common.scratch_path(spark, "digest_index"), id_type=docs.schema["doc_id"].dataType.simpleString())
    found = digest_index.deduplicate(docs, index)
    index.close()
    return found


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: ten documents for each benchmark item."""
    return lexical_search.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (start:end in code points, comma-joined)."""
    found = toxicity.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    spans = F.transform("passages", lambda x: F.concat_ws(":", x["start"], x["end"]))
    return found.select("doc_id", "held_out", "score", "predicted", F.array_join(spans, ",").alias("passages"))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: in every tenth document by the hash of its id, words from a point on repeat those that begin there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", h.alias("h"), F.floor(h / 10).alias("g"), F.filter(F.split(common.text_of(), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    text = F.when(F.col("a").isNull(), F.array_join("w", " ")).otherwise(
        F.array_join(F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))), " "))
    return rows.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the longest run (nulls without one), runs_sha256, collapsed_sha256. A null id repeats nothing."""
    found = periodic.find_runs(_with_repeats(_documents(spark, sf_dir)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    exponent = F.floor(1000 * length / period).cast("long")
    return found.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_token_counts": op2_token_counts,
    "op3_weak_label_quality": op3_weak_label_quality,
    "op4_quality_rules": op4_quality_rules,
    "op5_jump_sharding": op5_jump_sharding,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash": op7_simhash,
    "op8_contextual_pii": op8_contextual_pii,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_lexical_search": op11_lexical_search,
    "op12_toxic_passages": op12_toxic_passages,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op11_lexical_search": """
        WITH words AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ts FROM documents),
        docs AS (SELECT *, CAST(len(ts) AS BIGINT) AS n FROM words WHERE len(ts) > 0),
        total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_all FROM docs),
        items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS t FROM benchmark),
        asked AS (SELECT DISTINCT t FROM items),
        post AS (SELECT r, doc_id, n, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS t FROM docs) SEMI JOIN asked USING (t) GROUP BY ALL),
        dfs AS (SELECT t, count(*) AS df FROM post GROUP BY t),
        adds AS (SELECT p.r, p.doc_id, p.t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_all))) AS x
                 FROM post p JOIN dfs USING (t) CROSS JOIN total),
        found AS (SELECT item_id, r, doc_id, CAST(sum(x) AS BIGINT) AS score FROM items JOIN adds USING (t) GROUP BY ALL HAVING sum(x) > 0)
        SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM found
        WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10""",
    "op6_line_dedup": """
        WITH rows AS (SELECT doc_id, row_number() OVER () AS r, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT r, doc_id, site, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM rows),
        bad AS (SELECT trim(l, ' ') AS b FROM lines WHERE trim(l, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 8)
        SELECT doc_id, count(*) FILTER (trim(l, ' ') <> '') AS n_lines, count(b) AS n_removed,
               sha256(coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (b IS NULL), '')) AS clean_sha256
        FROM lines LEFT JOIN bad ON trim(l, ' ') = b GROUP BY r, doc_id""",
    "op9_exact_dedup": """
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                          sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256 FROM documents),
        k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n
              WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""",
}
