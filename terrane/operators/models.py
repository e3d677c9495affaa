"""Model pools: which models a stage draws from, and who may refine whose output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import curate


def diverse(pools: DataFrame) -> DataFrame:
    """``pools`` (pool, name, family); a pool with fewer than two families is an error."""
    counted = pools.groupBy("pool").agg(F.count_distinct("family").alias("_families"))
    ok = F.when(F.col("_families") >= 2, F.col("pool")).otherwise(F.raise_error(F.concat(F.lit("one family only in pool "), F.col("pool"))).cast("string"))
    return pools.join(counted.select(ok.alias("pool")), "pool")


def from_config(spark: SparkSession, data: dict) -> tuple[DataFrame, DataFrame]:
    """The pools and the stages' pools of a configuration; every pool has to be diverse."""
    pools = [(pool, m["name"], m["family"], m.get("provider"), m.get("model_id")) for pool, ms in data["pools"].items() for m in ms]
    stages = list(data["stage_pools"].items())
    return diverse(spark.createDataFrame(pools, "pool string, name string, family string, provider string, model_id string")), spark.createDataFrame(stages, "stage string, pool string")


def stage_models(stages: DataFrame, pools: DataFrame) -> DataFrame:
    """stage, name, family: ``stages`` (stage, pool) with their pools' models."""
    return stages.join(F.broadcast(pools), "pool").select("stage", "name", "family")


def refiners(models: DataFrame) -> DataFrame:
    """stage, generator, refiner: of one stage and of different families."""
    a = models.select("stage", F.col("name").alias("generator"), F.col("family").alias("_a"))
    b = models.select("stage", F.col("name").alias("refiner"), F.col("family").alias("_b"))
    return a.join(F.broadcast(b), "stage").where("_a <> _b").select("stage", "generator", "refiner")


def draw(models: DataFrame, requests: DataFrame, seed: int) -> DataFrame:
    """One model of its stage for each request (iteration, stage), uniform and repeatable."""
    order = curate.ticket(seed, F.col("iteration"), F.col("name"))
    return requests.join(F.broadcast(models), "stage").groupBy("iteration", "stage").agg(F.min_by("name", order).alias("name"))
