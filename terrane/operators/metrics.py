"""Detector metrics and paired comparisons of training settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SETTING = ["detector", "train_set", "test_set"]


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(predictions: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, fn, n and precision, recall, f1 per group of ``label`` and ``pred``."""
    hit, wrong, missed = (F.col("pred") == 1) & (F.col("label") == 1), (F.col("pred") == 1) & (F.col("label") == 0), (F.col("pred") == 0) & (F.col("label") == 1)
    counts = predictions.groupBy(*keys).agg(F.count_if(hit).alias("tp"), F.count_if(wrong).alias("fp"), F.count_if(missed).alias("fn"), F.count("*").alias("n"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rates = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumn("f1", ratio(2 * p * r, p + r))


def mean_over_seeds(runs: DataFrame, metric: str = "f1") -> DataFrame:
    """Mean of 100 x metric and number of seeds per detector, training set, config and test set."""
    return runs.groupBy("detector", "train_set", "config", "test_set").agg(F.avg(F.col(metric) * 100).alias("value"), F.count("*").alias("seeds"))


def seed_counts(table: DataFrame) -> DataFrame:
    return table.agg(F.array_sort(F.collect_set("seeds")).alias("seed_counts"))


def settings(table: DataFrame, configs: list[str]) -> DataFrame:
    """One row per setting with every config's value, rounded to two places."""
    return table.groupBy(*SETTING).pivot("config", configs).agg(F.round(F.first("value"), 2))


def gains(table: DataFrame, ours: str, baselines: list[str]) -> DataFrame:
    """Mean relative gain in % over each baseline, for all settings, in and across datasets, and per detector.

    Settings where the baseline is 0 don't count; a group without any has null. The groups overlap, so each setting
    is exploded into the groups it belongs to.
    """
    mine = table.where(F.col("config") == ours).select(*SETTING, F.col("value").alias("ours"))
    base = table.where(F.col("config").isin(baselines)).select(*SETTING, F.col("config").alias("baseline"), F.col("value").alias("base"))
    groups = F.array(F.lit("all"), F.when(F.col("train_set") == F.col("test_set"), "in_dataset").otherwise("cross_dataset"), F.concat(F.lit("detector="), F.col("detector")))
    gain = F.when(F.col("base") > 0, (F.col("ours") - F.col("base")) / F.col("base") * 100)
    paired = base.join(mine, SETTING).select("baseline", gain.alias("gain"), F.explode(groups).alias("group"))
    return paired.groupBy("group", "baseline").agg(F.avg("gain").alias("mean_gain"), F.count("gain").alias("pairs"))


def best_settings(wide: DataFrame, ours: str, others: list[str]) -> DataFrame:
    """In how many settings that have all values ours is the largest; ties lose."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [ours, *others]])
    wins = reduce(lambda a, b: a & b, [F.col(ours) > F.col(c) for c in others])
    return wide.agg(F.count_if(present & wins).alias("best"), F.count("*").alias("settings"))


def below(wide: DataFrame, reference: str, configs: list[str]) -> DataFrame:
    """Per config the settings in which it is below the reference config."""
    counts = wide.agg(*[F.count_if(F.col(c) < F.col(reference)).alias(c) for c in configs])
    return counts.unpivot([], configs, "config", "below")


def results_long(wide: DataFrame, ids: list[str], datasets: list[str], metrics: list[str]) -> DataFrame:
    """Columns named dataset_metric turned into rows: ids, test_set, metric, value."""
    long = wide.unpivot(ids, [f"{d}_{m}" for d in datasets for m in metrics], "_name", "value")
    return long.select(*ids, F.substring_index("_name", "_", 1).alias("test_set"), F.substring_index("_name", "_", -1).alias("metric"), "value")


def jobs(spark, detectors: list[str], train_sets: list[str], configs: list[str], seeds: list[int]) -> DataFrame:
    """Every combination; bounded by the four lists."""
    out = None
    for name, values in (("detector", detectors), ("train_set", train_sets), ("config", configs), ("seed", seeds)):
        table = spark.createDataFrame([(v,) for v in values], f"{name} {'int' if name == 'seed' else 'string'}")
        out = table if out is None else out.crossJoin(F.broadcast(table))
    return out


def best_epoch(epochs: DataFrame, *keys: str) -> DataFrame:
    """The epoch of the best validation score; the earliest of equal ones."""
    order = F.struct(F.col("f1"), -F.col("epoch"))
    return epochs.groupBy(*keys).agg(F.max_by("epoch", order).alias("epoch"), F.max("f1").alias("f1"))
