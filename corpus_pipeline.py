"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Rows that no known language explains go; lines that are boilerplate of their source go; one document of each group of
near-duplicates (five-word shingles, similarity 0.8) stays; documents contaminated by ``benchmark`` go; the rest is
mixed to target weights, of which the documents that the mix takes are returned in its order.

Stages that run Python hand it ``BATCH_ROWS`` rows at a time: Spark holds a batch's texts several times outside its heap.
They lower the session's setting for that; ``run`` puts it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane import shared
from terrane.llm import decontam, langid, line_dedup, mixing, neardup

BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: Language models and suffix automata have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` of ``sf_dir``; a stage's own tables go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = spark.conf.get(_ROWS)
    try:
        for name, stage in STAGES[:-1]:
            path = shared.new_path(spark, name)
            with shared.temporary(spark):
                out = stage(spark, docs, sf_dir)
                out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
    finally:
        spark.conf.set(_ROWS, rows)
    return STAGES[-1][1](spark, docs, sf_dir)
