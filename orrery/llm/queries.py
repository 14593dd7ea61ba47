"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, langid, licenses, linededup, lm, mixing, simhash, sketch, tokencounts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and deleted lines of each document, and the SHA-256 of what stays of its text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.deduplicate(docs).select("doc_id", F.col("_lines.n").alias("n_lines"), F.col("_lines.removed").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that a document states."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by source, language and tokenizer version."""
    return tokencounts.totals(_table(spark, sf_dir, "documents"))


def op9_threshold_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that a document contains."""
    return decontaminate.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_simhash_near_dedup,
        op3_source_mix,
        op4_language_id,
        op5_warc_bundles,
        op6_license_scan,
        op7_lm_scores,
        op8_token_counts,
        op9_threshold_sketches,
        op10_decontamination,
    )
}
