"""Queries over measurements and recorded evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import bins
from terrane.operators import atlas, evidence
from terrane.plans import stand_ins as S

_W = S.with_tables


def measured(s, d):
    """One candidate per order line: flow analysis, size metrics, family."""
    line = S.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    family = F.get(F.array(*[F.lit(f) for f in [*atlas.FAMILIES, None]]), (F.col("l_partkey") % 11).cast("int"))
    kind = F.get(F.array(F.lit("conditional"), F.lit("loop"), F.lit("exception")), (F.col("l_suppkey") % 3).cast("int"))
    none = F.lit(None)
    edges = F.when(F.col("l_quantity") % 9 == 8, none).otherwise((F.col("l_quantity") % 9).cast("int"))
    structures = F.slice(F.array(F.struct(kind.alias("kind"), F.lit(1).alias("line"), F.lit("c").alias("code")), F.struct(F.lit("loop").alias("kind"), F.lit(2).alias("line"), F.lit("c").alias("code"))), F.lit(1), (F.col("l_linenumber") % 3).cast("int"))
    flow = F.struct(
        (F.col("l_tax") < 0.08).alias("target_found"),
        edges.alias("taint_edges"),
        F.when(F.col("l_discount") < 0.1, F.struct(F.lit("s").alias("code"), F.lit(1).alias("line"))).alias("sink"),
        structures.alias("structures"),
        F.array(F.struct((F.col("l_orderkey") % 2 == 0).alias("refs_source"))).alias("predicates"),
    )
    ccn, nloc = (F.col("l_partkey") % 15).cast("int"), (F.col("l_quantity") * 3).cast("int")
    return line.select("l_orderkey", "l_linenumber", *evidence.descriptor(family, flow, nloc, ccn), (F.col("l_partkey") % 13 != 0).alias("syntax_ok"), (F.col("l_suppkey") % 7 != 0).alias("passed"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount") * 4).alias("distance"))


_MEASURED = f"""m AS (SELECT *, {S._list([*atlas.FAMILIES, None])}[1 + l_partkey % 11] AS d1, l_tax < 0.08 AS found, l_discount < 0.1 AS has_sink, CAST(l_quantity AS INT) % 9 AS edges,
    CAST(l_quantity * 3 AS INT) AS nloc, l_partkey % 15 AS ccn FROM lineitem),
    desc_ AS (SELECT *, CASE WHEN NOT found OR edges = 8 THEN NULL WHEN edges = 0 THEN 'zero' WHEN edges <= 2 THEN 'short' WHEN edges <= 5 THEN 'medium' ELSE 'long' END AS d2,
    CASE WHEN found AND has_sink THEN CASE l_linenumber % 3 WHEN 0 THEN 'linear' WHEN 2 THEN 'nested' ELSE ['conditional', 'loop', 'exception'][1 + l_suppkey % 3] END END AS d3,
    CASE WHEN found AND has_sink THEN CASE WHEN l_orderkey % 2 = 0 THEN 'guarded' ELSE 'unguarded' END END AS d4,
    CASE WHEN nloc >= 100 OR ccn >= 12 THEN 'large' WHEN nloc < 30 AND ccn < 5 THEN 'small' ELSE 'medium' END AS d5 FROM m)"""


def flags(s, d):
    """One evidence record per order line."""
    line = S.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    mix = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey")
    bit = lambda i: F.getbit(mix, F.lit(i)) == 1
    names = ["static_vuln_hit", "static_patched_hit", "runtime_vuln_hit", "runtime_patched_hit", "runtime_vuln_done", "runtime_patched_done", "runtime_require_both"]
    family = F.get(F.array(*[F.lit(f) for f in atlas.FAMILIES]), (F.col("l_partkey") % 10).cast("int"))
    note = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.concat(F.lit("n"), i.cast("string")))
    return line.select("l_orderkey", "l_linenumber", family.alias("family"), *[bit(i).alias(n) for i, n in enumerate(names)], F.when(F.col("l_suppkey") % 5 == 0, "boom").otherwise("").alias("runtime_unrelated_error"), F.when(F.col("l_suppkey") % 7 == 0, "broken").otherwise("").alias("static_error"), note.alias("notes"))


_BITS = "l_orderkey * 7 + l_linenumber * 13 + l_partkey"
_FLAGS = f"""f AS (SELECT l_orderkey, l_linenumber, {S._list(list(atlas.FAMILIES))}[1 + l_partkey % 10] AS family, {', '.join(f'(({_BITS}) >> {i}) & 1 = 1 AS {n}' for i, n in enumerate(['sv', 'sp', 'rv', 'rp', 'vd', 'pd', 'rb']))},
    CASE WHEN l_suppkey % 5 = 0 THEN 'boom' ELSE '' END AS other, l_suppkey % 7 <> 0 AS static_ok FROM lineitem),
    v AS (SELECT *, static_ok AND sv AND NOT sp AS static_pass, vd AND (NOT rb OR pd) AND rv AND NOT rp AS runtime_pass,
    CASE WHEN sp AND NOT sv THEN 'static finding in the patched version only' WHEN sv AND sp THEN 'static finding still in the patched version'
    WHEN rp THEN 'runtime finding still in the patched version' WHEN other <> '' THEN 'unrelated runtime error: ' || other END AS contradiction FROM f)"""


def findings(s, d):
    """Order lines as findings of two versions."""
    line = S.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    version = F.when(F.col("l_linenumber") % 2 == 0, "patched").otherwise("vulnerable")
    return line.select(F.col("l_orderkey").alias("candidate_id"), version.alias("version"), F.concat(F.lit("q"), (F.col("l_partkey") % 20).cast("string")).alias("query_id"), F.col("l_quantity").cast("int").alias("line"))


def units(s, d):
    order = S.table(s, d, "orders").select(F.col("o_orderkey").alias("candidate_id"))
    return order.select("candidate_id", F.explode(F.array(F.lit("vulnerable"), F.lit("patched"))).alias("version")).select("candidate_id", "version", (F.col("candidate_id") % 20 + 1).cast("int").alias("first_line"), (F.col("candidate_id") % 20 + 21).cast("int").alias("last_line"))


def family_queries(s):
    rows = [(f"q{i}", f) for i in range(20) for k, f in enumerate(atlas.FAMILIES) if i % 10 == k or i == 19 - k]
    return s.createDataFrame(sorted(set(rows)), "query_id string, family string")


_FINDINGS = "findings AS (SELECT l_orderkey AS candidate_id, CASE WHEN l_linenumber % 2 = 0 THEN 'patched' ELSE 'vulnerable' END AS version, 'q' || (l_partkey % 20) AS query_id, CAST(l_quantity AS INT) AS line FROM lineitem)"
_IN = f"{_FINDINGS}, hit AS (SELECT f.* FROM findings f JOIN orders o ON o.o_orderkey = f.candidate_id WHERE f.line BETWEEN candidate_id % 20 + 1 AND candidate_id % 20 + 21)"
_FQ = "fq AS (SELECT * FROM (VALUES " + ", ".join(f"('q{i}', '{f}')" for i, f in sorted({(i, f) for i in range(20) for k, f in enumerate(atlas.FAMILIES) if i % 10 == k or i == 19 - k})) + ") t(query_id, family))"


def reports(s, d):
    """Order lines as sanitizer reports."""
    line = S.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    version = F.when(F.col("l_linenumber") % 2 == 0, "patched").otherwise("vulnerable")
    kind = F.get(F.array(F.lit("asan"), F.lit("ubsan"), F.lit("lsan")), (F.col("l_partkey") % 3).cast("int"))
    raw = F.get(F.array(F.lit("x Heap-Buffer-Overflow y"), F.lit("signed integer overflow"), F.lit("other")), (F.col("l_suppkey") % 3).cast("int"))
    return line.select(F.col("l_orderkey").alias("candidate_id"), version.alias("version"), kind.alias("kind"), (F.col("l_suppkey") % 11 != 0).alias("built"), F.lit(True).alias("ran"), (F.col("l_discount") > 0.03).alias("triggered"), raw.alias("raw"), F.when(F.col("l_suppkey") % 2 == 0, "E").otherwise("").alias("error_text"), (F.col("l_partkey") % 4 != 0).alias("in_target"))


def sanitized(s):
    return s.createDataFrame([("buffer_overflow", "asan", ["heap-buffer-overflow"]), ("null_dereference", "asan", ["zero page"]), ("integer_overflow", "ubsan", ["signed integer overflow", "shift"]), ("resource_leak", "lsan", ["other"])], "family string, sanitizer string, patterns array<string>")


QUERIES = {
    "taint_bins": lambda s, d: S.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", bins.taint_bin((F.col("l_quantity") % 9).cast("int")).alias("bin")),
    "size_tiers": lambda s, d: S.table(s, d, "part").select("p_partkey", bins.size_tier(F.col("p_size") * 3, F.col("p_size") % 14).alias("tier")),
    "descriptors": lambda s, d: measured(s, d).select("l_orderkey", "l_linenumber", *atlas.DIMS, F.array_join(evidence.missing_dims(), ",").alias("missing")),
    "admissible_descriptors": lambda s, d: measured(s, d).where(F.size(evidence.missing_dims()) == 0).groupBy(*atlas.DIMS).agg(F.count("*").alias("samples"), F.bool_and(atlas.admissible()).alias("admissible")),
    "requirement_texts": lambda s, d: S.cells(s).select("cell_key", F.array_join(evidence.requirements(), "\n").alias("text")),
    "evidence_verdict": lambda s, d: evidence.verdicts(flags(s, d)).select("l_orderkey", "l_linenumber", "static_pass", "runtime_pass", "contradiction", "passed", F.size("notes").alias("notes")),
    "evidence_diagnostics": lambda s, d: evidence.verdicts(flags(s, d)).withColumn("notes", F.slice("notes", 1, 1)).select("l_orderkey", "l_linenumber", evidence.weakness_diagnostics().alias("text")),
    "evidence_json": lambda s, d: S.table(s, d, "documents").select("doc_id", F.when(F.col("n_chars").isNotNull(), F.length(evidence.short_evidence(F.struct(F.lit("f").alias("family"), F.lpad(F.lit("x"), F.col("n_chars").cast("int"), F.lit("y")).alias("notes")), F.lit("f")))).alias("length")),
    "cascade_first_failure": lambda s, d: measured(s, d).select("l_orderkey", "l_linenumber", evidence.failed_check(F.col("distance")).alias("check")),
    "cascade_counts": lambda s, d: measured(s, d).groupBy(evidence.failed_check(F.col("distance")).alias("check")).agg(F.count("*").alias("candidates")),
    "line_range_findings": lambda s, d: evidence.findings_in_target(findings(s, d), units(s, d)).groupBy("candidate_id", "version").agg(F.count("*").alias("findings"), F.min("line").alias("first")),
    "static_evidence": lambda s, d: evidence.static_evidence(findings(s, d), units(s, d), family_queries(s)),
    "family_query_ids": lambda s, d: family_queries(s).groupBy("family").agg(F.array_join(F.array_sort(F.collect_set("query_id")), ",").alias("query_ids")),
    "runtime_evidence": lambda s, d: evidence.runtime_evidence(reports(s, d), sanitized(s)),
    "compressed_paths": lambda s, d: S.table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("p")).select("conv_id", F.array_join(bins.compressed_path(F.col("p")), ">").alias("path"), (F.size(bins.compressed_path(F.col("p"))) - 1).alias("edges")),
    "chosen_arguments": lambda s, d: S.table(s, d, "nation").select("n_nationkey", F.array_join(bins.chosen_arguments(F.array("n_name", F.lit("b"), F.lit("c")), F.when(F.col("n_nationkey") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("n_nationkey") % 3).cast("int"), F.lit(3)))), ",").alias("arguments")),
}
_REPORTS = """r AS (SELECT l_orderkey AS candidate_id, l_linenumber % 2 = 0 AS patched, ['asan', 'ubsan', 'lsan'][1 + l_partkey % 3] AS kind, l_suppkey % 11 <> 0 AS done, l_discount > 0.03 AS trig,
    ['x heap-buffer-overflow y', 'signed integer overflow', 'other'][1 + l_suppkey % 3] AS raw, CASE WHEN l_suppkey % 2 = 0 THEN 'E' ELSE 'abnormal termination' END AS err, l_partkey % 4 <> 0 AS tgt FROM lineitem),
    fam AS (SELECT * FROM (VALUES ('buffer_overflow', 'asan', 'heap-buffer-overflow'), ('null_dereference', 'asan', 'zero page'), ('integer_overflow', 'ubsan', 'signed integer overflow|shift'), ('resource_leak', 'lsan', 'other')) t(family, kind, p)),
    j AS (SELECT r.*, family, trig AND regexp_matches(raw, p) AS hit FROM r JOIN fam USING (kind))"""
_MEANS = {
    "d2": "CASE d2 WHEN 'zero' THEN '0 def-use edges' WHEN 'short' THEN '1-2 def-use edges' WHEN 'medium' THEN '3-5 def-use edges' ELSE '6 def-use edges or more' END",
    "d3": "CASE d3 WHEN 'linear' THEN 'no structure governs the sink' WHEN 'conditional' THEN 'one conditional governs the sink' WHEN 'loop' THEN 'one loop governs the sink' WHEN 'exception' THEN 'one handler governs the sink' ELSE 'two structures or more govern the sink' END",
    "d4": "CASE d4 WHEN 'guarded' THEN 'a governing predicate refers to the source' ELSE 'no governing predicate refers to the source' END",
    "d5": "CASE d5 WHEN 'small' THEN 'below 30 lines and complexity 5' WHEN 'medium' THEN 'between small and large' ELSE '100 lines or complexity 12 or more' END",
}
_CHECK = f"""WITH {_MEASURED} SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 13 = 0 THEN 'syntax' WHEN d1 IS NULL OR l_suppkey % 7 = 0 THEN 'weakness'
    WHEN d2 IS NULL OR d3 IS NULL OR d4 IS NULL OR (d1 = 'use_after_free' AND d2 = 'zero') OR (d3 IN ('linear', 'exception') AND d4 = 'guarded') THEN 'characterization'
    WHEN l_orderkey % 5 <> 0 AND l_discount * 4 < 0.2 THEN 'diversity' ELSE 'accepted' END AS "check" FROM desc_"""
SQL = {
    "taint_bins": "SELECT l_orderkey, l_linenumber, ['zero', 'short', 'short', 'medium', 'medium', 'medium', 'long', 'long', 'long'][1 + CAST(l_quantity AS INT) % 9] AS bin FROM lineitem",
    "size_tiers": "SELECT p_partkey, CASE WHEN p_size * 3 >= 100 OR p_size % 14 >= 12 THEN 'large' WHEN p_size * 3 < 30 AND p_size % 14 < 5 THEN 'small' ELSE 'medium' END AS tier FROM part",
    "descriptors": f"WITH {_MEASURED} SELECT l_orderkey, l_linenumber, d1, d2, d3, d4, d5, concat_ws(',', CASE WHEN d1 IS NULL THEN 'd1' END, CASE WHEN d2 IS NULL THEN 'd2' END, CASE WHEN d3 IS NULL THEN 'd3' END, CASE WHEN d4 IS NULL THEN 'd4' END) AS missing FROM desc_",
    "admissible_descriptors": f"WITH {_MEASURED} SELECT d1, d2, d3, d4, d5, count(*) AS samples, NOT ((d1 = 'use_after_free' AND d2 = 'zero') OR (d3 IN ('linear', 'exception') AND d4 = 'guarded')) AS admissible FROM desc_ WHERE d1 IS NOT NULL AND d2 IS NOT NULL AND d3 IS NOT NULL GROUP BY d1, d2, d3, d4, d5",
    "requirement_texts": f"""{_W('family', 'cells')} SELECT cell_key, 'Family: ' || n.display || ' (CWE ' || n.cwes || ').' || chr(10) || 'Taint length: ' || d2 || ' -- ' || {_MEANS['d2']} || '.' || chr(10) || 'Control flow: ' || d3 || ' -- ' || {_MEANS['d3']} || '.' || chr(10)
        || 'Guard: ' || d4 || ' -- ' || {_MEANS['d4']} || '.' || chr(10) || 'Size: ' || d5 || ' -- ' || {_MEANS['d5']} || '.' AS text FROM cells JOIN (SELECT family, display, string_agg(CAST(cwe AS VARCHAR), ', ' ORDER BY cwe) AS cwes FROM family GROUP BY ALL) n ON n.family = d1""",
    "evidence_verdict": f"WITH {_FLAGS} SELECT l_orderkey, l_linenumber, static_pass, runtime_pass, contradiction, (static_pass OR runtime_pass) AND contradiction IS NULL AS passed, 12 AS notes FROM v",
    "evidence_diagnostics": f"""{_W('family')}, {_FLAGS} SELECT l_orderkey, l_linenumber, concat_ws(chr(10), 'Weakness family ' || n.display || ':', CASE WHEN NOT (sv OR rv) THEN '  - no tool reports the weakness inside the target function of the vulnerable version' END,
        '  - contradicting evidence: ' || contradiction, '  - n1') AS text FROM v JOIN (SELECT DISTINCT family, display FROM family) n USING (family)""",
    "evidence_json": "SELECT doc_id, CAST(CASE WHEN greatest(n_chars, 0) + 26 < 20000 THEN n_chars + 25 ELSE 31 END AS INT) AS length FROM documents",
    "cascade_first_failure": _CHECK,
    "cascade_counts": f'SELECT "check", count(*) AS candidates FROM ({_CHECK}) GROUP BY "check"',
    "line_range_findings": f"WITH {_IN} SELECT candidate_id, version, count(*) AS findings, min(line) AS first FROM hit GROUP BY ALL",
    "static_evidence": f"WITH {_IN}, {_FQ} SELECT candidate_id, family, bool_or(version = 'vulnerable') AS static_vuln_hit, bool_or(version = 'patched') AS static_patched_hit, count(*) AS findings FROM hit JOIN fq USING (query_id) GROUP BY ALL",
    "family_query_ids": f"WITH {_FQ} SELECT family, string_agg(query_id, ',' ORDER BY query_id) AS query_ids FROM fq GROUP BY family",
    "runtime_evidence": f"""WITH {_REPORTS} SELECT candidate_id, family, bool_or(done AND NOT patched) AS runtime_vuln_done, bool_or(done AND patched) AS runtime_patched_done, bool_or(done AND NOT patched AND hit AND tgt) AS runtime_vuln_hit,
        bool_or(done AND patched AND hit) AS runtime_patched_hit, bool_or(patched) AS runtime_require_both,
        coalesce(max('patched version: ' || err) FILTER (done AND patched AND trig AND NOT hit), max(err) FILTER (done AND NOT patched AND trig AND NOT (hit AND tgt)), '') AS runtime_unrelated_error FROM j GROUP BY ALL""",
    "compressed_paths": """WITH l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS p FROM conversations)
        SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS path, count(*) - 1 AS edges FROM l WHERE p IS NULL OR p <> role GROUP BY conv_id""",
    "chosen_arguments": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name || ',b,c' WHEN 1 THEN n_name || ',c' ELSE 'b,c' END AS arguments FROM nation",
}
