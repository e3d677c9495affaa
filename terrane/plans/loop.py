"""Queries over flows, prompts and the replay of a whole generation loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import bins, prompts
from terrane.functions import text as T
from terrane.operators import atlas, evidence, flows, replay
from terrane.plans import stand_ins as S

_W = S.with_tables
MODES = ["use_after_free", "leak", "standard"]
NODES = ["IF", "WHILE", "CATCH", "ELSE", "RETURN", "SWITCH", "DO"]


def flow_records(s, d):
    line = S.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    mode = F.get(F.array(*[F.lit(m) for m in MODES]), (F.col("l_orderkey") % 3).cast("int"))
    return line.select(F.col("l_orderkey").alias("candidate_id"), mode.alias("mode"), (F.col("l_partkey") % 4).cast("int").alias("edges"), (F.col("l_suppkey") % 10).cast("int").alias("sink_line"), F.col("l_linenumber").alias("flow_id"))


def node_records(s, d):
    line = S.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    label = F.get(F.array(*[F.lit(n) for n in NODES]), (F.col("l_suppkey") % 7).cast("int"))
    return line.select(F.col("l_orderkey").alias("candidate_id"), (F.col("l_partkey") % 3).cast("int").alias("node"), label.alias("label"), (F.col("l_suppkey") % 50).cast("int").alias("line"), F.col("l_linenumber").alias("seq"))


class Tables:
    """The driver's tables as recorded output: a response per vector."""

    def __init__(self, spark, d) -> None:
        v = S.table(spark, d, "embeddings").select("vec_id", "label", "embedding")
        family = F.get(F.array(*[F.lit(f) for f in atlas.FAMILIES]), F.col("label").cast("int"))
        self.rows = v.withColumns({"id": F.concat(F.lit("r"), F.col("vec_id").cast("string")), "seq": F.col("vec_id"), "family": family})

    def responses(self):
        name = F.when(F.col("seq") % 11 == 0, "g").otherwise("f")
        code = F.concat(F.lit("int f(int a) {\n// "), F.col("id"), F.lit("\n}"))
        patched = F.concat(F.lit("int "), name, F.lit("(int a) {\n}"))
        return self.rows.select("id", "seq", "family", T.render_candidate(code, patched, F.lit("int main() {}")).alias("text"))

    def evidence(self):
        flag = lambda k: F.col("seq") % k != 0
        return self.rows.select("id", "family", flag(7).alias("static_vuln_hit"), F.lit(False).alias("static_patched_hit"), *[F.lit(False).alias(f"runtime_{n}") for n in ("vuln_hit", "patched_hit", "vuln_done", "patched_done", "require_both")], F.lit("").alias("runtime_unrelated_error"), F.lit("").alias("static_error"), F.array().cast("array<string>").alias("notes"))

    def measurements(self):
        point = F.struct(F.lit("s").alias("code"), F.lit(1).alias("line"))
        flow = F.struct((F.col("seq") % 13 != 0).alias("target_found"), (F.col("seq") % 2).cast("int").alias("taint_edges"), point.alias("sink"), F.array(F.struct(F.lit("loop").alias("kind"))).alias("structures"), F.array(F.struct(F.lit(True).alias("refs_source"))).alias("predicates"))
        return self.rows.select("id", flow.alias("flow"), F.lit(10).alias("nloc"), F.lit(1).alias("ccn"))

    def vectors(self):
        return self.rows.select("id", "embedding")


def _prompt_rows(s, d):
    docs = S.table(s, d, "documents").select("doc_id", "text")
    req = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("one"), F.lit("two")))
    refs = F.array(F.struct(F.when(F.col("doc_id") % 2 == 0, "787").otherwise("").alias("cwe"), F.col("text").alias("code")))
    memory = F.when(F.col("doc_id") % 5 == 0, F.array(F.struct(F.lit("syntax").alias("failed_check"), F.lit("close braces").alias("lesson")))).otherwise(F.array().cast("array<struct<failed_check:string,lesson:string>>"))
    vary = F.when(F.col("doc_id") % 7 == 0, F.col("text"))
    return docs.withColumns({"req": req, "refs": refs, "memory": memory, "vary": vary})


QUERIES = {
    "shortest_flow": lambda s, d: flows.shortest(flow_records(s, d)),
    "controlling_structures": lambda s, d: flows.structures(node_records(s, d)).select("candidate_id", F.array_join(F.transform("structures", lambda x: F.concat_ws(":", x["line"], x["node"], x["kind"])), ",").alias("structures")),
    "global_names": lambda s, d: S.table(s, d, "documents").select("doc_id", F.array_join(F.array_sort(flows.global_names(F.split("text", " "), F.array(F.lit("the"), F.lit("de")), F.array(F.lit("of")))), " ").alias("names")).select("doc_id", F.sha2("names", 256).alias("names_sha")),
    "flow_modes": lambda s, d: S.table(s, d, "nation").select("n_nationkey", flows.flow_mode(F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("free"))).otherwise(F.array()), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("open"))).otherwise(F.array())).alias("mode")),
    "prompt_generation": lambda s, d: _prompt_rows(s, d).select("doc_id", F.sha2(prompts.generation(F.col("req"), F.col("refs"), F.col("memory"), F.col("vary"), F.lit("densify"), 500), 256).alias("sha")),
    "prompt_refinement": lambda s, d: _prompt_rows(s, d).select("doc_id", F.sha2(prompts.refinement(F.lit("weakness"), F.col("req"), F.lit("code"), F.col("text"), 300), 256).alias("sha")),
    "replay_outcomes": lambda s, d: replay.outcomes(Tables(s, d), 0.8).select("id", "check", "cell_key"),
    "replay_archive": lambda s, d: replay.archive(Tables(s, d), 0.8).select("id", "cell_key", "family", F.sha2("code", 256).alias("code_sha"), "target_name"),
    "event_accounting": lambda s, d: S.log(s, d).groupBy("stage").agg(F.count("*").alias("iterations"), F.count_if("accepted").alias("accepted"), F.count_distinct("target_key").alias("targets")),
    "run_outcomes": lambda s, d: S.table(s, d, "orders").select("o_orderkey", evidence.run_outcome(F.when(F.col("o_orderkey") % 4 == 0, "x\n  ERROR: LeakSanitizer: y \nz").otherwise("fine"), F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 5 - 2).cast("int")).alias("o")).select("o_orderkey", "o.*"),
    "mean_pooling": lambda s, d: S.table(s, d, "embeddings").select("vec_id", bins.mean_pool(F.array("embedding", F.reverse("embedding"))).alias("v")).select("vec_id", F.round(F.element_at("v", 1), 5).alias("first"), F.round(F.element_at("v", 7), 5).alias("seventh")),
    "diagnostic_texts": lambda s, d: S.rounds(s, d).where("stage <> 'accepted'").select("run", "round", F.concat_ws(": ", "stage", F.lit("failed")).alias("text")),
}
_REFS = "'References for style only:' || chr(10) || '--- reference 1' || CASE WHEN doc_id % 2 = 0 THEN ' (CWE 787)' ELSE '' END || ' ---' || chr(10) || CASE WHEN length(text) > 500 THEN left(text, 500) || chr(10) || '/* ... truncated ... */' ELSE text END"
_NN = "chr(10) || chr(10)"
_REPLAY = f"""WITH RECURSIVE b AS (SELECT vec_id AS seq, 'r' || vec_id AS id, {S._list(list(atlas.FAMILIES))}[1 + label] AS family, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    o AS (SELECT *, CASE WHEN seq % 11 = 0 THEN 'syntax' WHEN seq % 7 = 0 THEN 'weakness' WHEN seq % 13 = 0 OR (family = 'use_after_free' AND seq % 2 = 0) THEN 'characterization' ELSE 'accepted' END AS c0,
        family || CASE WHEN seq % 2 = 0 THEN '|zero' ELSE '|short' END || '|loop|guarded|small' AS key FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS k FROM o WHERE c0 = 'accepted'),
    near AS (SELECT a.key, a.k, list(z.k) AS conflicts FROM r a JOIN r z ON a.key = z.key AND z.k < a.k AND 1 - list_dot_product(a.e, z.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(z.e, z.e)) + 1e-12) < 0.8 GROUP BY ALL),
    c AS (SELECT r.key, r.k, coalesce(n.conflicts, []) AS conflicts FROM r LEFT JOIN near n USING (key, k)),
    g AS (SELECT key, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM c GROUP BY key
        UNION ALL SELECT g.key, c.k, CASE WHEN len(list_intersect(g.kept, c.conflicts)) = 0 THEN list_append(g.kept, c.k) ELSE g.kept END FROM g JOIN c ON c.key = g.key AND c.k = g.k + 1),
    last AS (SELECT key, arg_max(kept, k) AS kept FROM g GROUP BY key),
    outc AS (SELECT o.id, o.seq, o.family, CASE WHEN o.c0 = 'accepted' AND NOT list_contains(l.kept, r.k) THEN 'diversity' ELSE o.c0 END AS "check", CASE WHEN o.c0 = 'accepted' AND list_contains(l.kept, r.k) THEN o.key END AS cell_key FROM o LEFT JOIN r USING (seq) LEFT JOIN last l ON l.key = r.key)"""
SQL = {
    "shortest_flow": """WITH f AS (SELECT l_orderkey AS candidate_id, l_partkey % 4 AS edges, l_suppkey % 10 AS sink_line, l_linenumber AS flow_id FROM lineitem WHERE l_orderkey % 3 <> 0 OR l_partkey % 4 > 0)
        SELECT candidate_id, edges, sink_line, flow_id, count(*) OVER (PARTITION BY candidate_id) AS flows FROM f QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY edges, sink_line, flow_id) = 1""",
    "controlling_structures": f"""WITH n AS (SELECT l_orderkey AS candidate_id, l_partkey % 3 AS node, {S._list(NODES)}[1 + l_suppkey % 7] AS label, l_suppkey % 50 AS line, l_linenumber AS seq FROM lineitem),
        k AS (SELECT *, CASE WHEN label IN ('IF', 'SWITCH', 'ELSE') THEN 'conditional' WHEN label IN ('FOR', 'WHILE', 'DO') THEN 'loop' WHEN label = 'CATCH' THEN 'exception' END AS kind FROM n),
        f AS (SELECT * FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY candidate_id, node ORDER BY seq, line, kind) = 1)
        SELECT candidate_id, string_agg(line || ':' || node || ':' || kind, ',' ORDER BY line, node, kind) AS structures FROM f GROUP BY candidate_id""",
    "global_names": "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents), u AS (SELECT DISTINCT doc_id, w FROM w WHERE w NOT IN ('the', 'de', 'of')) SELECT d.doc_id, sha256(coalesce(string_agg(w, ' ' ORDER BY encode(w)), '')) AS names_sha FROM documents d LEFT JOIN u USING (doc_id) GROUP BY d.doc_id",
    "flow_modes": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'use_after_free' WHEN n_nationkey % 2 = 0 THEN 'leak' ELSE 'standard' END AS mode FROM nation",
    "prompt_generation": f"""SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN 'No descriptor is required.' ELSE 'Target descriptor:' || chr(10) || '- one' || chr(10) || '- two' END || {_NN} || {_REFS}
        || CASE WHEN doc_id % 5 = 0 THEN {_NN} || 'Lessons:' || chr(10) || '- When syntax failed: close braces' ELSE '' END
        || CASE WHEN doc_id % 7 = 0 THEN {_NN} || 'Produce a new variant. {prompts.VARY["densify"]}' || chr(10) || '--- sample to vary ---' || chr(10) || text ELSE '' END) AS sha FROM documents""",
    "prompt_refinement": f"""SELECT doc_id, sha256('The candidate failed the weakness check.' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_NN} || 'Target descriptor:' || chr(10) || '- one' || chr(10) || '- two' END
        || {_NN} || 'Candidate:' || chr(10) || 'code' || {_NN} || 'Diagnostics:' || chr(10) || right(text, 300) || {_NN} || '{prompts.REFINE["weakness"]}') AS sha FROM documents""",
    "replay_outcomes": f'{_REPLAY} SELECT id, "check", cell_key FROM outc',
    "replay_archive": f"{_REPLAY} SELECT id, cell_key, family, sha256('int f(int a) {{' || chr(10) || '// ' || id || chr(10) || '}}') AS code_sha, 'f' AS target_name FROM outc WHERE \"check\" = 'accepted'",
    "event_accounting": f"{_W('log')} SELECT stage, count(*) AS iterations, count(*) FILTER (accepted) AS accepted, count(DISTINCT target_key) AS targets FROM log GROUP BY stage",
    "run_outcomes": """SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey % 5 < 2 OR o_orderkey % 4 = 0 AS triggered,
        CASE WHEN o_orderkey % 4 = 0 THEN 'ERROR: LeakSanitizer: y' WHEN o_orderkey % 3 = 0 THEN 'timeout' WHEN o_orderkey % 5 < 2 THEN 'signal ' || (2 - o_orderkey % 5) ELSE '' END AS error_text FROM orders""",
    "mean_pooling": """WITH p AS (SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) + CAST(embedding[len(embedding) + 1 - i] AS DOUBLE)) AS v FROM embeddings)
        SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 5) AS first, round(v[7] / sqrt(list_dot_product(v, v)), 5) AS seventh FROM p""",
    "diagnostic_texts": f"{_W('rounds')} SELECT run, round, stage || ': failed' AS text FROM rounds WHERE stage <> 'accepted'",
}
