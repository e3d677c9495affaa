"""Curation: reference pools, decontamination by normalised hash, dedup in arrival order, samples and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane import shared
from terrane.functions import text as T
from terrane.operators import atlas

ROWS_PER_RANGE = 1_000_000


def require_split(df: DataFrame, split: str = "train") -> DataFrame:
    """``df``, whose rows of any other split are an error."""
    wrong = F.raise_error(F.concat(F.lit(f"expected split {split}, found "), F.coalesce("split", F.lit("null"))))
    return df.withColumn("split", F.when(F.col("split") == split, F.col("split")).otherwise(wrong.cast("string")))


def test_hashes(*tests: DataFrame) -> DataFrame:
    """The distinct normalised hashes of the code in any of the held-out sets."""
    out = None
    for t in tests:
        part = t.select(T.normalised_hash(F.col("code")).alias("code_hash"))
        out = part if out is None else out.unionAll(part)
    return out.distinct()


def reference_pool(train: DataFrame, *tests: DataFrame) -> DataFrame:
    """Positive training rows of known family whose code is in no held-out set.

    The cheap label filter and the broadcast look-up come first, so that only what is left is hashed. Only distinct
    hashes of the held-out sets are shuffled.
    """
    positive = atlas.with_family(train.where(F.col("target") == 1)).where(F.col("family").isNotNull())
    hashed = positive.withColumn("code_hash", T.normalised_hash(F.col("code")))
    return hashed.join(test_hashes(*tests), "code_hash", "left_anti").drop("code_hash")


def keep_first(df: DataFrame, by: Column, order: str = "seq") -> DataFrame:
    """The first row, in ``order``, of each value of ``by``.

    The first position per digest is a partial aggregate, so thousands of copies cost one row per task.
    """
    keyed = df.withColumn("_by", F.sha2(by, 256))
    first = keyed.groupBy("_by").agg(F.min(order).alias(order))
    return keyed.join(first, ["_by", order], "left_semi").drop("_by")


def numbered(df: DataFrame, order: Column, name: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``df`` with its 0-based position in the order of a numeric column.

    Rows are dealt to ranges of about ``rows_per_range`` and written to the shared folder with their range, so that it
    stays theirs. Ranges are numbered each by itself and start at the rows of the ranges before; no task sorts
    everything, and only the ranges' sizes meet in one.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_order", order)
    ranges = -(-keyed.count() // rows_per_range)
    if ranges <= 1:
        return keyed.withColumn(name, F.row_number().over(W.partitionBy(F.lit(1)).orderBy("_order")).cast("long") - 1).drop("_order")
    path = shared.new_path(spark, "ranges")
    keyed = keyed.repartitionByRange(ranges, "_order").withColumn("_range", F.spark_partition_id())
    keyed.write.parquet(path)
    keyed = spark.read.schema(keyed.schema).parquet(path)
    sizes = keyed.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_range").orderBy("_order")
    out = keyed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
    return out.drop("_order", "_range", "_start")


def collect_baseline(df: DataFrame, approach: str, code: str = "code", order: str = "seq") -> DataFrame:
    """Distinct non-blank samples in arrival order with dense ids: id, code, label, source.

    Positions are chosen and numbered by digest alone; the texts join them once at the end.
    """
    clean = df.select(order, T.strip(F.coalesce(code, F.lit(""))).alias("code")).where("code <> ''")
    first = clean.groupBy(F.sha2("code", 256).alias("_by")).agg(F.min(order).alias(order)).select(order)
    kept = clean.join(numbered(first, F.col(order), "_k"), order)
    return kept.select(F.concat(F.lit(f"{approach}::"), F.col("_k").cast("string")).alias("id"), "code", F.lit(1).alias("label"), F.lit(approach).alias("source"))


def ticket(seed: int, *key: Column) -> Column:
    """A digest that orders rows at random, the same way for the same seed."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]), 256)


def seeded_sample(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """``n`` rows drawn uniformly without replacement (all, if there are fewer)."""
    return df.orderBy(ticket(seed, F.col(key)), key).limit(n)


def group_sample(df: DataFrame, n: int, seed: int, group: str, key: str = "id") -> DataFrame:
    """``n`` rows of each group. Ranks are limited before the shuffle, so a hot group ships n rows per task."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(ticket(seed, F.col(key)), key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def seeded_shuffle(df: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """``df`` with its position in a seeded random order."""
    return numbered(df, F.conv(F.substring(ticket(seed, F.col(key)), 1, 13), 16, 10).cast("long"), "position")


def epoch_seed(seed: int, epoch: int) -> int:
    return seed * 1000 + epoch


def training_set(train: DataFrame, augmentation: DataFrame | None) -> DataFrame:
    """The union of training rows and augmentation rows, which count as positive."""
    base = train.select("id", "code", F.col("target").cast("int").alias("label"))
    if augmentation is None:
        return base
    return base.unionByName(augmentation.select("id", "code", F.lit(1).alias("label")))


def augmentation_enabled(name: Column) -> Column:
    return name.isNotNull() & ~F.lower(name).isin("none", "orig")


def augmentation_sample(df: DataFrame, n: int, seed: int, source: str) -> DataFrame:
    """A sample of non-blank exported rows as augmentation: id, code, label, source."""
    filled = df.where(T.strip(F.coalesce("code", F.lit(""))) != "")
    return seeded_sample(filled, n, seed).select("id", "code", F.lit(1).alias("label"), F.coalesce("source", F.lit(source)).alias("source"))


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists in its store; the first of all if none does."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return next((p for p in paths if hadoop(p).getFileSystem(conf).exists(hadoop(p))), paths[0])
