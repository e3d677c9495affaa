"""Queries over predictions, results of training runs, and model pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import metrics, models
from terrane.plans import stand_ins as S

_W = S.with_tables
BASELINES = ["a", "b", "c", "d"]


def runs(s, d):
    return metrics.confusion(S.predictions(s, d), "detector", "train_set", "config", "seed", "test_set")


def means(s, d):
    return metrics.mean_over_seeds(runs(s, d))


def wide(s, d):
    return metrics.settings(means(s, d), S.CONFIGS)


def epochs(s, d):
    o = S.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return o.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), F.floor(F.col("o_totalprice") / 20000).cast("double").alias("f1"))


def model_pools(s):
    return s.createDataFrame([("first", "m1", "x"), ("first", "m2", "y"), ("local", "m3", "x"), ("local", "m4", "z"), ("local", "m5", "z")], "pool string, name string, family string")


def stage_models(s):
    stages = s.createDataFrame([("signup", "first"), ("view", "local"), ("click", "local")], "stage string, pool string")
    return models.stage_models(stages, models.diverse(model_pools(s)))


QUERIES = {
    "prf_metrics": runs,
    "mean_over_seeds": means,
    "seed_counts": lambda s, d: metrics.seed_counts(means(s, d)).select(F.array_join("seed_counts", ",").alias("seed_counts")),
    "relative_gain": lambda s, d: metrics.gains(means(s, d), "ours", BASELINES),
    "settings_pivot": wide,
    "best_settings": lambda s, d: metrics.best_settings(wide(s, d), "ours", BASELINES),
    "below_baseline": lambda s, d: metrics.below(wide(s, d), "orig", ["ours", *BASELINES]),
    "results_unpivot": lambda s, d: metrics.results_long(S.table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x_f1"), F.col("p_retailprice").alias("x_p"), (F.col("p_retailprice") / 2).alias("y_f1"), F.lit(None).cast("double").alias("y_p")), ["p_partkey"], ["x", "y"], ["f1", "p"]),
    "job_matrix": lambda s, d: metrics.jobs(s, ["d1", "d2", "d3"], S.TRAIN, S.CONFIGS, [0, 1, 2, 3, 4]),
    "best_epoch": lambda s, d: metrics.best_epoch(epochs(s, d), "run"),
    "stage_models": lambda s, d: stage_models(s),
    "refiner_choices": lambda s, d: models.refiners(stage_models(s)),
    "generator_draws": lambda s, d: models.draw(stage_models(s), S.log(s, d).select("iteration", "stage"), 3),
}
_RUNS = f"""{_W('predictions')}, c AS (SELECT detector, train_set, config, seed, test_set, count(*) FILTER (pred = 1 AND label = 1) AS tp, count(*) FILTER (pred = 1 AND label = 0) AS fp, count(*) FILTER (pred = 0 AND label = 1) AS fn, count(*) AS n FROM predictions GROUP BY ALL),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c),
    runs AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r)"""
_MEANS = f"{_RUNS}, means AS (SELECT detector, train_set, config, test_set, avg(100 * f1) AS value, count(*) AS seeds FROM runs GROUP BY ALL)"
_WIDE = f"{_MEANS}, wide AS (SELECT detector, train_set, test_set, {', '.join(f'round(max(value) FILTER (config = {chr(39)}{c}{chr(39)}), 2) AS {c}' for c in S.CONFIGS)} FROM means GROUP BY ALL)"
_STAGES = "sm AS (SELECT * FROM (VALUES ('signup', 'm1', 'x'), ('signup', 'm2', 'y'), ('view', 'm3', 'x'), ('view', 'm4', 'z'), ('view', 'm5', 'z'), ('click', 'm3', 'x'), ('click', 'm4', 'z'), ('click', 'm5', 'z')) t(stage, name, family))"
SQL = {
    "prf_metrics": f"{_RUNS} SELECT detector, train_set, config, seed, test_set, tp, fp, fn, n, precision, recall, f1 FROM runs",
    "mean_over_seeds": f"{_MEANS} SELECT * FROM means",
    "seed_counts": f"{_MEANS} SELECT string_agg(CAST(seeds AS VARCHAR), ',' ORDER BY seeds) AS seed_counts FROM (SELECT DISTINCT seeds FROM means)",
    "relative_gain": f"""{_MEANS}, p AS (SELECT b.detector, b.train_set, b.test_set, b.config AS baseline, CASE WHEN b.value > 0 THEN (o.value - b.value) / b.value * 100 END AS gain FROM means b JOIN means o USING (detector, train_set, test_set) WHERE o.config = 'ours' AND b.config IN ('a', 'b', 'c', 'd')),
        g AS (SELECT *, unnest(['all', CASE WHEN train_set = test_set THEN 'in_dataset' ELSE 'cross_dataset' END, 'detector=' || detector]) AS "group" FROM p)
        SELECT "group", baseline, avg(gain) AS mean_gain, count(gain) AS pairs FROM g GROUP BY ALL""",
    "settings_pivot": f"{_WIDE} SELECT * FROM wide",
    "best_settings": f"{_WIDE} SELECT count(*) FILTER (ours > a AND ours > b AND ours > c AND ours > d) AS best, count(*) AS settings FROM wide",
    "below_baseline": f"{_WIDE} " + " UNION ALL ".join(f"SELECT '{c}' AS config, count(*) FILTER ({c} < orig) AS below FROM wide" for c in ["ours", *BASELINES]),
    "results_unpivot": " UNION ALL ".join(f"SELECT p_partkey, '{t}' AS test_set, '{m}' AS metric, CAST({x} AS DOUBLE) AS value FROM part" for t, m, x in (("x", "f1", "p_size"), ("x", "p", "p_retailprice"), ("y", "f1", "p_retailprice / 2"), ("y", "p", "NULL"))),
    "job_matrix": f"SELECT unnest(['d1', 'd2', 'd3']) AS detector, train_set, config, seed FROM (SELECT unnest({S._list(S.TRAIN)}) AS train_set), (SELECT unnest({S._list(S.CONFIGS)}) AS config), (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS seed)",
    "best_epoch": "WITH e AS (SELECT o_custkey AS run, o_orderkey AS epoch, floor(o_totalprice / 20000) AS f1 FROM orders) SELECT run, epoch, f1 FROM e QUALIFY row_number() OVER (PARTITION BY run ORDER BY f1 DESC, epoch) = 1",
    "stage_models": f"WITH {_STAGES} SELECT stage, name, family FROM sm",
    "refiner_choices": f"WITH {_STAGES} SELECT a.stage, a.name AS generator, b.name AS refiner FROM sm a JOIN sm b ON a.stage = b.stage AND a.family <> b.family",
    "generator_draws": f"{_W('log')}, {_STAGES} SELECT iteration, stage, arg_min(name, sha256('3:' || iteration || ':' || name)) AS name FROM log JOIN sm USING (stage) GROUP BY iteration, stage",
}
