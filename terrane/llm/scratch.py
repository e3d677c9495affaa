"""Intermediate tables in the folder that the driver and all executors share, and other things operators have in common.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it again: the files survive the loss of
any executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.shared import new_path

__all__ = ["drawn", "fresh", "materialise", "new_path", "only_columns", "opened", "ship", "small"]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; looks at no more than one row beyond."""
    return df.limit(most_rows + 1).count() <= most_rows


def only_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns, whatever their names, can't clash with an operator's own."""
    return df.select(*[df[f"`{n}`"] for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many leading underscores as set them apart from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def threshold(wanted: int, total: int) -> int:
    """Below which of the hashes 0 .. 2**63 - 1 a row is drawn, for about ``wanted`` of ``total`` rows, in whole numbers."""
    return min((1 << 63) - 1, (wanted << 63) // max(1, total))


def drawn(key: Column, wanted: int, total: int) -> Column:
    """Whether a row is in a sample of about ``wanted`` of ``total`` rows, by a hash of ``key``; all are, of fewer rows."""
    if total <= wanted:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 1) < F.lit(threshold(wanted, total))


def ship(spark: SparkSession, state) -> Broadcast:
    """A broadcast of ``state`` whose classes travel with their code, for ``opened``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(state))


@contextmanager
def opened(shipped: Broadcast, keep: bool = True, read=cloudpickle.loads) -> Iterator:
    """What was shipped; unless ``keep``, it leaves the worker's memory again and stays in the executor's blocks.

    ``read`` makes it from the bytes that were broadcast, and may look at them in place.
    """
    state = getattr(shipped, "_opened", None)
    if state is None:
        state = read(shipped.value)
        if getattr(shipped, "_path", None) is not None and hasattr(shipped, "_value"):
            del shipped._value
        if keep:
            shipped._opened = state
    yield state
