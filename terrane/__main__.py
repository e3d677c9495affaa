"""Command line: atlas, collect, pool, sample, aggregate, jobs, synthesize, export, check-tools."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import atlas, curate, metrics, replay
from terrane.sources import config, readers, writers


def _atlas(spark: SparkSession, a) -> DataFrame:
    return atlas.summary(spark)


def _collect(spark: SparkSession, a) -> DataFrame:
    rows = readers.READERS[a.approach](spark, a.inputs).withColumn("seq", F.monotonically_increasing_id())
    return curate.collect_baseline(rows, a.approach)


def _pool(spark: SparkSession, a) -> DataFrame:
    train = readers.split(spark, a.root, a.dataset, "train").withColumn("target", F.col("label"))
    tests = [readers.split(spark, a.root, t, "test") for t in a.tests]
    return curate.reference_pool(curate.require_split(train), *tests)


def _sample(spark: SparkSession, a) -> DataFrame:
    return curate.augmentation_sample(spark.read.json(a.input), a.n, a.seed, "synthetic")


class _Folder:
    """Recorded output of a run as tables below a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        for name in ("responses", "evidence", "measurements", "vectors"):
            setattr(self, name, lambda name=name: spark.read.parquet(f"{root}/{name}"))


def _synthesize(spark: SparkSession, a) -> DataFrame:
    """The outcome of every recorded response; the accepted ones are appended to the archive."""
    tables = _Folder(spark, a.recorded)
    delta = config.settings(config.load(a.config) if a.config else {}).hyper.delta_min_distance
    if a.archive:
        writers.append(replay.archive(tables, delta), a.archive, "family")
    return replay.outcomes(tables, delta)


def _export(spark: SparkSession, a) -> DataFrame:
    rows = spark.read.parquet(a.archive)
    return spark.createDataFrame([(writers.export(rows, a.to),)], "written long")


def _check_tools(spark: SparkSession, a) -> DataFrame:
    expected, actual = config.load(a.expected), config.load(a.actual)
    wrong = config.version_mismatches(expected, actual)
    return spark.createDataFrame([(tool, expected[tool], actual.get(tool), tool not in wrong) for tool in sorted(expected)], "tool string, expected string, actual string, ok boolean")


def _aggregate(spark: SparkSession, a) -> DataFrame:
    means = metrics.mean_over_seeds(readers.results(spark, a.results), a.metric)
    return metrics.gains(means, a.ours, a.baselines)


def _jobs(spark: SparkSession, a) -> DataFrame:
    return metrics.jobs(spark, a.detectors, a.train_sets, a.configs, a.seeds)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="terrane")
    parser.add_argument("--out", help="write JSON lines here instead of showing them")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("atlas").set_defaults(run=_atlas)
    p = sub.add_parser("collect")
    p.add_argument("approach", choices=sorted(readers.READERS))
    p.add_argument("inputs", nargs="+")
    p.set_defaults(run=_collect)
    p = sub.add_parser("pool")
    p.add_argument("root")
    p.add_argument("dataset")
    p.add_argument("tests", nargs="*")
    p.set_defaults(run=_pool)
    p = sub.add_parser("sample")
    p.add_argument("input")
    p.add_argument("n", type=int)
    p.add_argument("--seed", type=int, default=0)
    p.set_defaults(run=_sample)
    p = sub.add_parser("aggregate")
    p.add_argument("results")
    p.add_argument("ours")
    p.add_argument("baselines", nargs="+")
    p.add_argument("--metric", default="f1", choices=["f1", "precision", "recall"])
    p.set_defaults(run=_aggregate)
    p = sub.add_parser("synthesize")
    p.add_argument("recorded", help="a folder with the tables responses, evidence, measurements and vectors")
    p.add_argument("--archive", help="where accepted samples are appended")
    p.add_argument("--config")
    p.set_defaults(run=_synthesize)
    p = sub.add_parser("export")
    p.add_argument("archive")
    p.add_argument("to")
    p.set_defaults(run=_export)
    p = sub.add_parser("check-tools")
    p.add_argument("expected")
    p.add_argument("actual")
    p.set_defaults(run=_check_tools)
    p = sub.add_parser("jobs")
    for name in ("detectors", "train-sets", "configs"):
        p.add_argument(f"--{name}", nargs="+", required=True)
    p.add_argument("--seeds", nargs="+", type=int, default=[0, 1, 2, 3, 4])
    p.set_defaults(run=_jobs)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("terrane").getOrCreate()
    out = a.run(spark, a)
    if a.out:
        print(writers.jsonl(out, a.out))
    else:
        for row in writers.report(out).toLocalIterator():
            print(row.json)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
