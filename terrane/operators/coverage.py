"""Coverage of the cells by archived samples, and what the iteration log says in order.

``archive``: seq, cell_key, family (and more). ``events``: iteration, stage, target_key, accepted, cell_key.
Per-cell state is bounded by the number of cells; running sums over the whole log are two-level, so that no task holds
the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.operators import atlas, curate

TAU, K_ATTEMPTS = 50, 10


def cell_counts(archive: DataFrame) -> DataFrame:
    return archive.groupBy("cell_key").agg(F.count("*").alias("samples"))


def family_coverage(archive: DataFrame, cells: DataFrame) -> DataFrame:
    """Every family with its covered and admissible cells."""
    covered = archive.select("cell_key").distinct().withColumn("_hit", F.lit(1))
    return cells.join(covered, "cell_key", "left").groupBy(F.col("d1").alias("family")).agg(F.count("_hit").alias("covered"), F.count("*").alias("cells"))


def uncovered(archive: DataFrame, cells: DataFrame, exhausted: DataFrame | None = None) -> DataFrame:
    """Admissible cells without samples that aren't exhausted."""
    out = cells.join(archive.select("cell_key").distinct(), "cell_key", "left_anti")
    return out if exhausted is None else out.join(exhausted.select("cell_key"), "cell_key", "left_anti")


def low_density(archive: DataFrame, tau: int = TAU) -> DataFrame:
    """Covered cells below ``tau`` samples, and whether theirs is the least count."""
    low = cell_counts(archive).where(F.col("samples") < tau)
    return low.withColumn("least", F.col("samples") == F.min("samples").over(W.partitionBy(F.lit(1))))


def expansion_scores(archive: DataFrame, cells: DataFrame, exhausted: DataFrame | None = None) -> DataFrame:
    """Candidates for expansion with their number of covered neighbours."""
    covered = archive.select(F.col("cell_key").alias("dst_key")).distinct()
    near = atlas.edges(cells).join(covered, "dst_key").groupBy(F.col("src_key").alias("cell_key")).agg(F.count("*").alias("near"))
    out = uncovered(archive, cells, exhausted).join(near, "cell_key", "left")
    return out.select("cell_key", F.col("d1").alias("family"), F.coalesce("near", F.lit(0)).alias("score"))


def next_expansion(scores: DataFrame, seed: int, iteration: int, n: int = 1) -> DataFrame:
    """The ``n`` best candidates; ties in a seeded random order."""
    return scores.orderBy(F.col("score").desc(), curate.ticket(seed, F.lit(iteration), F.col("cell_key"))).limit(n)


def next_densification(archive: DataFrame, seed: int, iteration: int, tau: int = TAU) -> DataFrame:
    """One of the least dense cells below ``tau``, and the archived sample to vary."""
    cell = low_density(archive, tau).where("least").orderBy(curate.ticket(seed, F.lit(iteration), F.col("cell_key"))).limit(1)
    samples = archive.join(F.broadcast(cell.select("cell_key", "samples")), "cell_key")
    return samples.orderBy(curate.ticket(seed, F.lit(iteration), F.col("seq"))).limit(1).select("cell_key", "samples", "seq")


def neighbour_targets(archive: DataFrame, cells: DataFrame, exhausted: DataFrame | None = None) -> DataFrame:
    """For each covered cell its uncovered neighbours of the same family that aren't exhausted."""
    family = cells.select(F.col("cell_key").alias("src_key"), F.col("d1").alias("family"))
    open_cells = uncovered(archive, cells, exhausted).select(F.col("cell_key").alias("dst_key"), F.col("d1").alias("family"))
    pairs = atlas.edges(cells).join(family, "src_key").join(open_cells, ["dst_key", "family"])
    return pairs.join(archive.select(F.col("cell_key").alias("src_key")).distinct(), "src_key", "left_semi").select("src_key", "dst_key", "family")


def first_in_cell(archive: DataFrame) -> DataFrame:
    """Each sample and whether it was its cell's first."""
    first = archive.groupBy("cell_key").agg(F.min("seq").alias("first_seq"))
    return archive.join(F.broadcast(first), "cell_key").select("seq", "cell_key", (F.col("seq") == F.col("first_seq")).alias("new_cell"))


def coverage_curve(archive: DataFrame) -> DataFrame:
    """seq of every cell's first sample, and how many cells were covered then. As many rows as cells."""
    first = archive.groupBy("cell_key").agg(F.min("seq").alias("seq"))
    return first.select("seq", "cell_key", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("seq")).alias("covered"))


def export_order(archive: DataFrame) -> DataFrame:
    """Samples with the sort key of an export: cells by first appearance, then arrival."""
    first = archive.groupBy("cell_key").agg(F.min("seq").alias("first_seq"))
    return archive.join(F.broadcast(first), "cell_key").orderBy("first_seq", "seq")


def attempts(events: DataFrame, k: int = K_ATTEMPTS) -> DataFrame:
    """Per target: failed attempts while uncovered, and whether and when these reached ``k``.

    An iteration counts if its target has no sample after it. Only the first ``k`` of a target are ranked.
    """
    covered = events.where("accepted").groupBy("cell_key").agg(F.min("iteration").alias("covered_at"))
    tried = events.where("target_key is not null").join(F.broadcast(covered.withColumnRenamed("cell_key", "target_key")), "target_key", "left")
    failed = tried.where("covered_at is null or iteration < covered_at")
    total = failed.groupBy("target_key").agg(F.count("*").alias("attempts"))
    rank = F.row_number().over(W.partitionBy("target_key").orderBy("iteration"))
    kth = failed.select("target_key", "iteration", rank.alias("_r")).where(F.col("_r") <= k).where(F.col("_r") == k).select("target_key", F.col("iteration").alias("exhausted_at"))
    return total.join(kth, "target_key", "left")


def no_new_streak(events: DataFrame, rows_per_range: int = curate.ROWS_PER_RANGE) -> DataFrame:
    """Every iteration and the length of the run without a new cell that ends there.

    The last new cell before an iteration is looked up over ranges of the log, so that the log isn't sorted in one task.
    """
    first = events.where("accepted").groupBy("cell_key").agg(F.min("iteration").alias("iteration")).select("iteration", F.lit(True).alias("new_cell"))
    numbered = curate.numbered(events.select("iteration"), F.col("iteration"), "_n", rows_per_range)
    marked = numbered.join(first, "iteration", "left").withColumn("_range", F.floor(F.col("_n") / rows_per_range))
    at = F.when(F.col("new_cell"), F.col("_n"))
    last = marked.groupBy("_range").agg(F.max(at).alias("_last"))
    before = W.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("_range", F.max("_last").over(before).alias("_carried"))
    inside = W.partitionBy("_range").orderBy("_n").rowsBetween(W.unboundedPreceding, 0)
    out = marked.join(F.broadcast(carried), "_range").withColumn("_at", F.coalesce(F.max(at).over(inside), F.col("_carried"), F.lit(-1)))
    return out.select("iteration", F.coalesce("new_cell", F.lit(False)).alias("new_cell"), (F.col("_n") - F.col("_at")).alias("streak"))


def run_summary(events: DataFrame, cells: DataFrame, k: int = K_ATTEMPTS) -> DataFrame:
    """iterations, accepted, stage (of the last iteration), covered, exhausted and admissible, in one row."""
    one = F.lit(1).alias("_row")
    accepted = F.count_if("accepted").alias("accepted")
    base = events.agg(F.count("*").alias("iterations"), accepted, F.max_by("stage", "iteration").alias("stage"), F.count_distinct(F.when(F.col("accepted"), F.col("cell_key"))).alias("covered"), one)
    spent = attempts(events, k).agg(F.count("exhausted_at").alias("exhausted"), one)
    return base.join(spent, "_row").join(cells.agg(F.count("*").alias("admissible"), one), "_row").drop("_row")


def memory_lookup(memory: DataFrame, requests: DataFrame, k: int) -> DataFrame:
    """The ``k`` latest entries of a request's family, those of its cell first.

    No more than k entries of each cell can be wanted, so only these meet the requests.
    """
    latest = F.row_number().over(W.partitionBy("family", "cell_key").orderBy(F.col("seq").desc()))
    wanted = memory.withColumn("_r", latest).where(F.col("_r") <= k).select("seq", "family", F.col("cell_key").alias("_cell"))
    pairs = requests.join(wanted, "family")
    order = W.partitionBy("family", "cell_key").orderBy((F.col("cell_key") == F.col("_cell")).desc(), F.col("seq").desc())
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("family", "cell_key", "rank", "seq")


def round_transitions(rounds: DataFrame, stages: list[str]) -> DataFrame:
    """Per round after the first: the stage before and whether the check got further. ``rounds``: run, round, stage."""
    before = F.lag("stage").over(W.partitionBy("run").orderBy("round"))
    place = lambda c: F.array_position(F.array(*[F.lit(s) for s in stages]), c)
    out = rounds.withColumn("previous", before).where("previous is not null")
    known = (place(F.col("stage")) > 0) & (place(F.col("previous")) > 0)
    return out.select("run", "round", "previous", "stage", (known & (place(F.col("stage")) > place(F.col("previous")))).alias("progressed"))
