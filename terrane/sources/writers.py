"""Writers of the record formats; all commit through Spark."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from terrane.operators import coverage


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write JSON lines and return how many, counted on the way."""
    seen = Observation("written")
    df.observe(seen, F.count("*").alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def append(df: DataFrame, path: str, *partitions: str) -> None:
    """Append to a log or archive, optionally by partition."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def snapshot(df: DataFrame, path: str) -> None:
    """Replace a small table; readers see the old or the new one."""
    df.coalesce(1).write.mode("overwrite").json(path)


def export(archive: DataFrame, path: str) -> int:
    """Archived samples as training records, by first appearance of their cell and then arrival."""
    rows = coverage.export_order(archive)
    fields = {"id": "id", "code": "code", "label": F.lit(1), "patched": "patched", "context": "context", "target_name": "target_name", "family": "family", "cell": F.split("cell_key", r"\|"), "source": F.lit("synthetic")}
    return jsonl(rows.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items() if not isinstance(v, str) or v in rows.columns]), path)


def sample_with_meta(sample: DataFrame, available: int, path: str, seed: int, source: str) -> int:
    """A sample and, beside it, how it was drawn."""
    n = jsonl(sample, path)
    meta = sample.sparkSession.createDataFrame([(source, available, n, seed, "uniform without replacement")], "input string, available long, sampled long, seed int, method string")
    snapshot(meta, f"{path}.meta")
    return n


def results(runs: DataFrame, path: str) -> None:
    """Results by detector, training set, config and seed."""
    runs.write.mode("append").partitionBy("detector", "train_set", "config", "seed").json(path)


def detector_csv(rows: DataFrame, path: str) -> None:
    """The four columns that a detector's trainer reads, two of them blank, all quoted."""
    rows.select(F.col("code").alias("processed_func"), F.col("label").alias("target"), F.lit("").alias("flaw_line"), F.lit("").alias("flaw_line_index")).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def report(df: DataFrame) -> DataFrame:
    """Rows as JSON texts."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def encoded_vectors(vector: Column) -> Column:
    """A vector as base64 of half-precision numbers."""

    @F.pandas_udf("string")
    def encode(vectors: pd.Series) -> pd.Series:
        import base64

        import numpy as np

        return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, np.float16).tobytes()).decode())

    return encode(vector)
