"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}
_SCOPES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without the setting gets a folder of its own."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="terrane-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/terrane/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return "/".join([_own_dir(spark), *_SCOPES, f"{name}-{uuid.uuid4().hex}"])


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Paths that are made inside go when it ends; what has to stay is written to a path from before."""
    _SCOPES.append(f"step-{uuid.uuid4().hex}")
    folder = "/".join([_own_dir(spark), *_SCOPES])
    try:
        yield
    finally:
        _SCOPES.pop()
        _delete(spark, folder)


def release(spark: SparkSession) -> bool:
    """Remove this application's intermediate tables; results that still read them have to be written before."""
    return _delete(spark, _own_dir(spark))
