"""The registered queries of this subpackage: each operator with its production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, langid, license_scan, line_dedup, mixing, neardup, secrets, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.report(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("hits")


def op2_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "documents"), k=4)


def op3_language_id(spark: SparkSession, d: str) -> DataFrame:
    return langid.of_pages(table(spark, d, "pages"), table(spark, d, "documents"))


def op4_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.report(table(spark, d, "documents"))


def op5_nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return ann.search(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_source_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(table(spark, d, "documents"))


def op7_warc_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages"))


def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.report(table(spark, d, "documents"), table(spark, d, "labels"))


def op9_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.report(table(spark, d, "documents"))


def op10_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secrets.report(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_benchmark_decontamination": op1_benchmark_decontamination,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_language_id": op3_language_id,
        "op4_license_scan": op4_license_scan,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_source_mix": op6_source_mix,
        "op7_warc_round_trip": op7_warc_round_trip,
        "op8_toxicity": op8_toxicity,
        "op9_line_dedup": op9_line_dedup,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; the others are tested against brute force."""
    return {"op1_benchmark_decontamination": decontam.ORACLE_SQL, "op2_minhash_near_dedup": neardup.oracle_sql(4), "op4_license_scan": license_scan.oracle_sql(), "op6_source_mix": mixing.ORACLE_SQL, "op7_warc_round_trip": warc.ORACLE_SQL, "op9_line_dedup": line_dedup.ORACLE_SQL, "op10_secret_scan": secrets.oracle_sql()}
