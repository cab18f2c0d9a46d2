"""The queries of this subpackage: name -> (spark, folder of tables) -> DataFrame, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, license_scan, line_dedup, mixing, secret_scan, simhash, sql, substring_dedup, suffix_dedup, toxicity


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(_table(spark, folder, "documents")))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup(_table(spark, folder, "documents"))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.dedup(_table(spark, folder, "documents"))
    return found.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The contract's columns, and n_elsewhere: passages of over 50 words may be shorter than a window of 400 bytes."""
    found = suffix_dedup.dedup(_table(spark, folder, "documents"), passages=True)
    return found.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", "n_elsewhere")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.train(docs, _table(spark, folder, "labels"))
    return toxicity.score(docs, model)


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(_table(spark, folder, "documents"))


def op7_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(_table(spark, folder, "embeddings"))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels"), keep=["doc_id"])
    each = [F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)]
    return found.select("doc_id", "n_tokens", *each, "rate")


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.cluster(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_line_dedup, op3_substring_dedup, op4_suffix_dedup, op5_toxicity, op6_secret_scan, op7_ann, op8_mixing, op9_simhash, op10_decontaminate)
}

SQL: dict[str, str] = {"op1_license_scan": sql.license_scan(), "op3_substring_dedup": sql.substring_dedup()}
