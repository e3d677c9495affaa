"""Queries over the atlas, the archive, the iteration log and archived vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import atlas, coverage, curate, diversity, refine, schedule
from terrane.plans import stand_ins as S
from terrane.streaming import jobs

_W = S.with_tables
DELTA = 0.8


def memory(spark, d):
    """Accepted samples as memory entries."""
    return S.archive(spark, d)


def exhausted(spark, d):
    return coverage.attempts(S.log(spark, d), 10).where("exhausted_at is not null").select(F.col("target_key").alias("cell_key"))


def grid(spark):
    return S.cells(spark).select("cell_key", *atlas.DIMS)


def resumed_state(spark, d):
    """What a scheduler resumes from the whole log, all of it taken as bootstrapping."""
    log = S.log(spark, d).withColumn("stage", F.lit(schedule.STAGES[0]))
    s = schedule.Scheduler.resume(spark, S.archive(spark, d), log, budget=1 << 40).state
    row = (s.stage, s.family_index, s.no_new_streak, s.iterations, sum(s.samples.values()), len(s.samples), sum(s.attempts.values()), len(s.exhausted))
    return spark.createDataFrame([row], "stage string, family_index long, no_new_streak long, iterations long, samples long, covered long, attempts long, exhausted long")


def resumed(spark, d):
    """The next task of a scheduler that resumes from the whole log."""
    s = schedule.Scheduler.resume(spark, S.archive(spark, d), S.log(spark, d), budget=1 << 40, seed=5, tau=1 << 30)
    task = s.next()
    row = (task.stage, task.mode, task.target, task.family, s.state.iterations, sum(s.state.samples.values()), len(s.state.exhausted))
    return spark.createDataFrame([row], "stage string, mode string, target_key string, family string, iterations long, samples long, exhausted int")


def streamed_vectors(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    stream = jobs.events(spark, f"{d}/embeddings.parquet").select(F.col("vec_id").alias("seq"), F.col("label").alias("cell_key"), "embedding")
    return jobs.drain(jobs.greedy_admission(stream, DELTA), "admission")


QUERIES = {
    "atlas_cells": lambda s, d: S.cells(s).select("ordinal", "cell_key", *atlas.DIMS),
    "atlas_summary": lambda s, d: atlas.summary(s),
    "subspace_cells": lambda s, d: atlas.cells(s, ("d1", "d2", "d4")).select("cell_key", "d1", "d2", "d4"),
    "family_cells": lambda s, d: grid(s).groupBy(F.col("d1").alias("family")).agg(F.count("*").alias("cells")),
    "atlas_edges": lambda s, d: atlas.edges(grid(s)),
    "atlas_degree": lambda s, d: atlas.edges(grid(s)).groupBy("src_key").agg(F.count("*").alias("degree")),
    "atlas_same_family_edges": lambda s, d: atlas.edges(grid(s)).where(F.substring_index("src_key", "|", 1) == F.substring_index("dst_key", "|", 1)).groupBy("dim").agg(F.count("*").alias("edges")),
    "cell_key_parse": lambda s, d: S.archive(s, d).select("seq", atlas.parse_key(F.col("cell_key")).alias("_k")).select("seq", "_k.*"),
    "cell_counts": lambda s, d: coverage.cell_counts(S.archive(s, d)),
    "coverage": lambda s, d: S.archive(s, d).agg(F.count("*").alias("samples"), F.count_distinct("cell_key").alias("covered")),
    "family_coverage": lambda s, d: coverage.family_coverage(S.archive(s, d), grid(s)),
    "uncovered_cells": lambda s, d: coverage.uncovered(S.archive(s, d), grid(s), exhausted(s, d)).select("cell_key"),
    "low_density_cells": lambda s, d: coverage.low_density(S.archive(s, d), 5),
    "expansion_scores": lambda s, d: coverage.expansion_scores(S.archive(s, d), grid(s), exhausted(s, d)),
    "next_expansion_target": lambda s, d: coverage.next_expansion(coverage.expansion_scores(S.archive(s, d), grid(s)), 5, 11),
    "next_densify_target": lambda s, d: coverage.next_densification(S.archive(s, d), 5, 11),
    "neighbor_targets": lambda s, d: coverage.neighbour_targets(S.archive(s, d), grid(s), exhausted(s, d)),
    "attempt_exhaustion": lambda s, d: coverage.attempts(S.log(s, d)),
    "no_new_streak": lambda s, d: coverage.no_new_streak(S.log(s, d)),
    "coverage_curve": lambda s, d: coverage.coverage_curve(S.archive(s, d)),
    "first_in_cell": lambda s, d: coverage.first_in_cell(S.archive(s, d)),
    "export_order": lambda s, d: coverage.export_order(S.archive(s, d)),
    "run_summary": lambda s, d: coverage.run_summary(S.log(s, d), grid(s)),
    "memory_topk": lambda s, d: coverage.memory_lookup(memory(s, d), grid(s).select(F.col("d1").alias("family"), "cell_key"), 3),
    "round_transitions": lambda s, d: coverage.round_transitions(S.rounds(s, d), S.FAILED),
    "rounds_per_run": lambda s, d: S.rounds(s, d).groupBy("run").agg(F.count("*").alias("checks"), (F.count("*") - 1).alias("refinements")),
    "pairwise_min_distance": lambda s, d: diversity.nearest_earlier(S.vectors(s, d)).select("seq", "cell_key", F.round("distance", 6).alias("distance")),
    "greedy_diversity": lambda s, d: diversity.greedy_admission(S.vectors(s, d), DELTA).select("seq", "cell_key", "accepted"),
    "archived_sample_draw": lambda s, d: curate.group_sample(S.archive(s, d).select(F.col("seq").cast("string").alias("id"), "cell_key"), 1, 9, "cell_key"),
    "scheduler_resume": resumed,
    "scheduler_state": resumed_state,
    "refinement_iterations": lambda s, d: refine.iterations(S.rounds(s, d)).select("run", F.array_join("history", ",").alias("history"), F.array_join("models", ",").alias("models"), "llm_calls", "rounds", "accepted", "failed_stage"),
    "refinement_calls": lambda s, d: refine.accounting(S.rounds(s, d)),
    "stream_event_counts": lambda s, d: jobs.drain(jobs.windowed_counts(jobs.events(s, f"{d}/events.parquet")), "counts", "complete").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total")),
    "stream_greedy_diversity": streamed_vectors,
}
_FAILED = "failed AS (SELECT l.* FROM log l LEFT JOIN (SELECT cell_key, min(iteration) AS at FROM log WHERE accepted GROUP BY cell_key) c ON l.target_key = c.cell_key WHERE c.at IS NULL OR l.iteration < c.at)"
_EXH = f"{_FAILED}, exhausted AS (SELECT target_key AS cell_key FROM failed GROUP BY 1 HAVING count(*) >= 10)"
_OPEN = "open AS (SELECT * FROM cells WHERE cell_key NOT IN (SELECT cell_key FROM archive) AND cell_key NOT IN (SELECT cell_key FROM exhausted))"
_SCORE = "SELECT o.cell_key, o.d1 AS family, count(a.cell_key) AS score FROM {0} o LEFT JOIN edges e ON e.src_key = o.cell_key LEFT JOIN (SELECT DISTINCT cell_key FROM archive) a ON a.cell_key = e.dst_key GROUP BY ALL"
_TICKET = "sha256('5:11:' || {0})"
_FAR = "(1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) + 1e-12))"
_VEC = "v AS (SELECT vec_id AS seq, label AS cell_key, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_FAMILIES = S._list(list(atlas.FAMILIES))
_CUT = f"""{_W('rounds')}, p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round) AS place FROM rounds),
    cut AS (SELECT * FROM p WHERE place <= 4 QUALIFY coalesce(bool_or(stage = 'accepted') OVER (PARTITION BY run ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) = false)"""
_GREEDY = f"""WITH RECURSIVE {_VEC}, r AS (SELECT *, row_number() OVER (PARTITION BY cell_key ORDER BY seq) AS k FROM v),
    near AS (SELECT a.cell_key, a.k, list(b.k) AS conflicts FROM r a JOIN r b ON a.cell_key = b.cell_key AND b.k < a.k AND {_FAR} < {DELTA} GROUP BY ALL),
    c AS (SELECT r.cell_key, r.k, coalesce(n.conflicts, []) AS conflicts FROM r LEFT JOIN near n USING (cell_key, k)),
    g AS (SELECT cell_key, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM c GROUP BY cell_key
        UNION ALL SELECT g.cell_key, c.k, CASE WHEN len(list_intersect(g.kept, c.conflicts)) = 0 THEN list_append(g.kept, c.k) ELSE g.kept END FROM g JOIN c ON c.cell_key = g.cell_key AND c.k = g.k + 1),
    last AS (SELECT cell_key, arg_max(kept, k) AS kept FROM g GROUP BY cell_key)
    SELECT r.seq, r.cell_key, list_contains(l.kept, r.k) AS accepted FROM r JOIN last l USING (cell_key)"""
SQL = {
    "atlas_cells": f"{_W('cells')} SELECT ordinal, cell_key, d1, d2, d3, d4, d5 FROM cells",
    "atlas_summary": f"{_W('grid')} SELECT count(*) AS total, count(*) FILTER (NOT admissible) AS excluded, count(*) FILTER (admissible) AS admissible, 'd1,d2,d3,d4,d5' AS dims, 'uaf_cannot_be_zero_taint,linear_cannot_be_guarded,exception_cannot_be_guarded' AS constraints FROM grid",
    "subspace_cells": f"{_W('grid')} SELECT DISTINCT d1 || '|' || d2 || '|' || d4 AS cell_key, d1, d2, d4 FROM grid WHERE NOT (d1 = 'use_after_free' AND d2 = 'zero')",
    "family_cells": f"{_W('cells')} SELECT d1 AS family, count(*) AS cells FROM cells GROUP BY d1",
    "atlas_edges": f"{_W('edges')} SELECT src_key, dst_key, dim FROM edges",
    "atlas_degree": f"{_W('edges')} SELECT src_key, count(*) AS degree FROM edges GROUP BY src_key",
    "atlas_same_family_edges": f"{_W('edges')} SELECT dim, count(*) AS edges FROM edges WHERE dim <> 'd1' GROUP BY dim",
    "cell_key_parse": f"{_W('archive')} SELECT seq, d1, d2, d3, d4, d5 FROM archive JOIN cells USING (cell_key)",
    "cell_counts": f"{_W('archive')} SELECT cell_key, count(*) AS samples FROM archive GROUP BY cell_key",
    "coverage": f"{_W('archive')} SELECT count(*) AS samples, count(DISTINCT cell_key) AS covered FROM archive",
    "family_coverage": f"{_W('archive')} SELECT d1 AS family, count(DISTINCT a.cell_key) AS covered, count(DISTINCT c.cell_key) AS cells FROM cells c LEFT JOIN archive a USING (cell_key) GROUP BY d1",
    "uncovered_cells": f"{_W('archive')}, {_EXH}, {_OPEN} SELECT cell_key FROM open",
    "low_density_cells": f"{_W('archive')}, n AS (SELECT cell_key, count(*) AS samples FROM archive GROUP BY cell_key HAVING count(*) < 5) SELECT *, samples = min(samples) OVER () AS least FROM n",
    "expansion_scores": f"{_W('archive', 'edges')}, {_EXH}, {_OPEN} {_SCORE.format('open')}",
    "next_expansion_target": f"{_W('archive', 'edges')}, s AS ({_SCORE.format('(SELECT * FROM cells WHERE cell_key NOT IN (SELECT cell_key FROM archive))')}) SELECT * FROM s ORDER BY score DESC, {_TICKET.format('cell_key')} LIMIT 1",
    "next_densify_target": f"""{_W('archive')}, n AS (SELECT cell_key, count(*) AS samples FROM archive GROUP BY cell_key HAVING count(*) < 50),
        c AS (SELECT * FROM n WHERE samples = (SELECT min(samples) FROM n) ORDER BY {_TICKET.format('cell_key')} LIMIT 1)
        SELECT cell_key, samples, seq FROM c JOIN archive USING (cell_key) ORDER BY {_TICKET.format('seq')} LIMIT 1""",
    "neighbor_targets": f"""{_W('archive', 'edges')}, {_EXH}, {_OPEN} SELECT src_key, dst_key, o.d1 AS family FROM edges e JOIN open o ON o.cell_key = e.dst_key
        JOIN cells c ON c.cell_key = e.src_key AND c.d1 = o.d1 WHERE src_key IN (SELECT cell_key FROM archive)""",
    "attempt_exhaustion": f"""{_W('log')}, {_FAILED}, r AS (SELECT *, row_number() OVER (PARTITION BY target_key ORDER BY iteration) AS k FROM failed)
        SELECT target_key, count(*) AS attempts, min(iteration) FILTER (k = 10) AS exhausted_at FROM r GROUP BY target_key""",
    "no_new_streak": f"""{_W('log')}, f AS (SELECT min(iteration) AS iteration FROM log WHERE accepted GROUP BY cell_key),
        m AS (SELECT l.iteration, f.iteration IS NOT NULL AS new_cell FROM log l LEFT JOIN f USING (iteration)),
        i AS (SELECT *, sum(new_cell::INT) OVER (ORDER BY iteration) AS island FROM m)
        SELECT iteration, new_cell, row_number() OVER (PARTITION BY island ORDER BY iteration) - (island > 0)::INT AS streak FROM i""",
    "coverage_curve": f"{_W('archive')}, f AS (SELECT cell_key, min(seq) AS seq FROM archive GROUP BY cell_key) SELECT seq, cell_key, row_number() OVER (ORDER BY seq) AS covered FROM f",
    "first_in_cell": f"{_W('archive')} SELECT seq, cell_key, seq = min(seq) OVER (PARTITION BY cell_key) AS new_cell FROM archive",
    "export_order": f"{_W('archive')} SELECT cell_key, seq, family, min(seq) OVER (PARTITION BY cell_key) AS first_seq FROM archive",
    "run_summary": f"""{_W('log')}, {_FAILED} SELECT (SELECT count(*) FROM log) AS iterations, (SELECT count(*) FROM log WHERE accepted) AS accepted, (SELECT count(DISTINCT cell_key) FROM log WHERE accepted) AS covered, (SELECT arg_max(stage, iteration) FROM log) AS stage,
        (SELECT count(*) FROM (SELECT 1 FROM failed GROUP BY target_key HAVING count(*) >= 10)) AS exhausted, (SELECT count(*) FROM cells) AS admissible""",
    "scheduler_state": f"""{_W('log')}, {_FAILED}, f AS (SELECT min(iteration) AS iteration FROM log WHERE accepted GROUP BY cell_key),
        m AS (SELECT l.iteration, split_part(target_key, '|', 1) AS family, f.iteration IS NOT NULL AS new FROM log l LEFT JOIN f USING (iteration)),
        t AS (SELECT arg_max(family, iteration) AS family FROM m)
        SELECT 'bootstrapping' AS stage, list_position({_FAMILIES}, t.family) - 1 AS family_index,
            (SELECT count(*) FROM m WHERE iteration > coalesce((SELECT max(iteration) FROM m WHERE family <> t.family OR new), -1)) AS no_new_streak,
            (SELECT count(*) FROM log) AS iterations, (SELECT count(*) FROM log WHERE accepted) AS samples, (SELECT count(DISTINCT cell_key) FROM log WHERE accepted) AS covered,
            (SELECT count(*) FROM failed) AS attempts, (SELECT count(*) FROM (SELECT 1 FROM failed GROUP BY target_key HAVING count(*) >= 10)) AS exhausted FROM t""",
    "scheduler_resume": f"""{_W('archive', 'edges')}, {_EXH}, {_OPEN}, s AS ({_SCORE.format('open')}), n AS (SELECT cell_key, count(*) AS samples FROM archive GROUP BY cell_key),
        k AS (SELECT (SELECT count(*) FROM log) AS iterations, (SELECT count(*) FROM archive) AS samples, (SELECT count(*) FROM exhausted) AS exhausted, (SELECT count(*) FROM open) AS still),
        e AS (SELECT cell_key, family FROM s, k ORDER BY score DESC, sha256('5:' || k.iterations || ':' || cell_key) LIMIT 1),
        l AS (SELECT n.cell_key, c.d1 AS family FROM n JOIN cells c USING (cell_key), k WHERE n.samples = (SELECT min(samples) FROM n) ORDER BY sha256('5:' || k.iterations || ':' || cell_key) LIMIT 1)
        SELECT CASE WHEN still > 0 THEN 'coverage_expansion' ELSE 'densification' END AS stage, CASE WHEN still > 0 THEN 'generate' ELSE 'densify' END AS mode,
            CASE WHEN still > 0 THEN (SELECT cell_key FROM e) ELSE (SELECT cell_key FROM l) END AS target_key, CASE WHEN still > 0 THEN (SELECT family FROM e) ELSE (SELECT family FROM l) END AS family,
            iterations, samples, exhausted FROM k""",
    "refinement_iterations": f"""{_CUT} SELECT run, string_agg(stage, ',' ORDER BY place) AS history, string_agg(model, ',' ORDER BY place) AS models, count(*) AS llm_calls, count(*) - 1 AS rounds,
        arg_max(stage, place) = 'accepted' AS accepted, nullif(arg_max(stage, place), 'accepted') AS failed_stage FROM cut GROUP BY run""",
    "refinement_calls": f"{_CUT} SELECT model, count(*) AS calls, count(*) FILTER (place = 1) AS as_generator, count(*) FILTER (place > 1) AS as_refiner FROM cut GROUP BY model",
    "memory_topk": f"""{_W('archive')} SELECT c.d1 AS family, c.cell_key, row_number() OVER (PARTITION BY c.cell_key ORDER BY (a.cell_key = c.cell_key) DESC, a.seq DESC) AS rank, a.seq
        FROM cells c JOIN archive a ON a.family = c.d1 QUALIFY rank <= 3""",
    "round_transitions": f"""{_W('rounds')}, l AS (SELECT *, lag(stage) OVER (PARTITION BY run ORDER BY round) AS previous FROM rounds)
        SELECT run, round, previous, stage, list_position({S._list(S.FAILED)}, stage) > list_position({S._list(S.FAILED)}, previous) AS progressed FROM l WHERE previous IS NOT NULL""",
    "rounds_per_run": f"{_W('rounds')} SELECT run, count(*) AS checks, count(*) - 1 AS refinements FROM rounds GROUP BY run",
    "pairwise_min_distance": f"WITH {_VEC} SELECT a.seq, a.cell_key, round(min({_FAR}), 6) AS distance FROM v a LEFT JOIN v b ON a.cell_key = b.cell_key AND b.seq < a.seq GROUP BY ALL",
    "greedy_diversity": _GREEDY,
    "stream_greedy_diversity": _GREEDY,
    "archived_sample_draw": f"{_W('archive')} SELECT CAST(seq AS VARCHAR) AS id, cell_key FROM archive QUALIFY row_number() OVER (PARTITION BY cell_key ORDER BY sha256('9:' || seq), CAST(seq AS VARCHAR)) = 1",
    "stream_event_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
