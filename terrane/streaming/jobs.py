"""Streaming twins of the batch operators: event counts in windows, cell coverage, and greedy admission by cell.

State is keyed (by window, or by cell) and lives in the state store; sources are files, sinks are files in the shared
folder, and every job resumes from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terrane.operators import diversity
from terrane.shared import new_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a Parquet path as a stream. It may be one file, a folder of them or a pattern, whatever its name."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).format("parquet")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(at):
        # A stream's source has to be a folder or a pattern.
        return stream.option("pathGlobFilter", at.getName()).load(str(at.getParent()))
    return stream.load(path)


def windowed_counts(stream: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums per window and key; rows later than ``late`` are left out."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", window), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


class Admission(StatefulProcessor):
    """Keeps a cell's admitted vectors and admits those that are far enough from all of them."""

    def __init__(self, delta: float) -> None:
        self.delta = delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "vector array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        units = diversity.unit_vectors(batch["embedding"])
        before = [np.asarray(v[0]) for v in self.kept.get()] if self.kept.exists() else []
        kept = np.array(before) if before else np.empty((0, units.shape[1]))
        accepted, _, kept = diversity.admitted(units, kept, self.delta)
        if len(kept) > len(before):
            self.kept.appendList([(v,) for v in kept[len(before) :].tolist()])
        yield pd.DataFrame({"seq": batch["seq"].to_numpy(), "cell_key": key[0], "accepted": accepted})

    def close(self) -> None:
        pass


def greedy_admission(stream: DataFrame, delta: float = 0.2) -> DataFrame:
    """seq, cell_key, accepted of a stream of seq, cell_key, embedding; needs the RocksDB state store."""
    kind = dict(stream.dtypes)
    return stream.select("seq", "cell_key", "embedding").groupBy("cell_key").transformWithStateInPandas(Admission(delta), outputStructType=f"seq {kind['seq']}, cell_key {kind['cell_key']}, accepted boolean", outputMode="Append", timeMode="None")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote."""
    spark = stream.sparkSession
    out, log = new_path(spark, name), new_path(spark, f"{name}-log")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
    else:
        def replace(batch: DataFrame, _) -> None:
            batch.write.mode("overwrite").parquet(out)

        query = stream.writeStream.outputMode("complete").option("checkpointLocation", log).foreachBatch(replace).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
