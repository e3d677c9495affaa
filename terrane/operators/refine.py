"""Refinement loops from recorded checks: history, calls, models and outcome of each iteration.

An iteration generates a candidate, checks it, and has a refiner mend it until a check accepts it or the rounds are
spent. Recorded rounds behind either end don't count. A run's rounds are bounded by the limit, so they are gathered
per run after that cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROUNDS = 3
ACCEPTED = "accepted"


def cut(rounds: DataFrame, most: int = ROUNDS) -> DataFrame:
    """``rounds`` (run, round, stage, model) up to the first accepted one and the limit of ``most`` refinements."""
    place = W.partitionBy("run").orderBy("round")
    kept = rounds.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most + 1)
    before = F.max(F.col("stage") == ACCEPTED).over(place.rowsBetween(W.unboundedPreceding, -1))
    return kept.withColumn("ended", F.coalesce(before, F.lit(False))).where("not ended").drop("ended")


def iterations(rounds: DataFrame, most: int = ROUNDS) -> DataFrame:
    """Per run: history, models, llm_calls, rounds (refinements), accepted, failed_stage."""
    gathered = cut(rounds, most).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("place", "stage", "model"))).alias("r"))
    last = F.element_at("r", -1)["stage"]
    return gathered.select(
        "run",
        F.transform("r", lambda x: x["stage"]).alias("history"),
        F.transform("r", lambda x: x["model"]).alias("models"),
        F.size("r").alias("llm_calls"),
        (F.size("r") - 1).alias("rounds"),
        (last == ACCEPTED).alias("accepted"),
        F.when(last != ACCEPTED, last).alias("failed_stage"),
    )


def accounting(rounds: DataFrame, most: int = ROUNDS) -> DataFrame:
    """Per model: how many calls it took as generator (a run's first) and as refiner."""
    first = F.col("place") == 1
    return cut(rounds, most).groupBy("model").agg(F.count("*").alias("calls"), F.count_if(first).alias("as_generator"), F.count_if(~first).alias("as_refiner"))
