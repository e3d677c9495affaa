"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Each source's documents are shuffled by a digest; a document's virtual finish time is its source's cumulative words
over the source's target. Served in that order, all sources reach their targets at virtual time 1, where the total
budget is spent; a source whose target is above its size starts over for a second pass. The document that straddles
the end is taken in part.

Targets: the budget (150 % of all words) is shared by weight; no source gets more than twice its size, and what is
over is shared again among the rest until none is above. The share per weight only rises while it is found, and each
time some sources reach their limit for good, so a few aggregates over the table of sources end at the exact level.

Scale: words are counted once and kept as a narrow table. The running sum is a two-level prefix sum: every source is
cut into digest ranges of about ``BUCKET_ROWS`` rows, so that a source with a third of all rows has a third of all
ranges; only the ranges' totals are summed per source. Sources are numbered by ranges as well.

Defined cases: a null source is a source of its own, ordered last; a null text has size 0 and is taken 0 times; equal
rows are told apart by nothing and may share what is taken in any order; sources without words have target 0; very long
texts count like any, and the one that straddles a target is taken in part; an empty table has no rows; extra columns
are ignored by ``mix`` and stay in ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from terrane.operators import curate

from .scratch import fresh, materialise, only_columns, small

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_PASSES = 2
BUCKET_ROWS = 2000
BROADCAST_ROWS = 500_000
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digest(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size, rows) with each one's target."""
    numbered = curate.numbered(sources, F.struct(F.col("source").isNull(), "source"), "place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod("place", F.lit(len(WEIGHTS))).cast("int"))
    s = numbered.select("source", "source_size", "rows", weight.alias("weight"), (F.col("source_size") * float(MOST_PASSES)).alias("cap"))
    s = materialise(s, "sources")
    level, before = 0.0, None
    while True:
        full = F.lit(level) * F.col("weight") >= F.col("cap")
        got = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if got == before or not got.weight:
            break
        level, before = ((got.all or 0) * BUDGET - (got.cap or 0.0)) / got.weight, got
    full = F.lit(level) * F.col("weight") >= F.col("cap")
    return s.select("source", "source_size", "rows", F.when(full, F.col("cap")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, finish (of its first pass; null if never reached)."""
    digest = _digest(F.col(doc_id), F.col(text))
    narrow = only_columns(docs, doc_id, source, text).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size(F.col(text)).alias("size"), digest.alias("digest"))
    narrow = materialise(narrow, "sizes")
    sources = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    sources = materialise(sources, "sources")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    share = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") / float(1 << 32)
    ranges = F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET_ROWS))
    dealt = narrow.join(sources, same(narrow, sources), "left").drop(sources["source"]).withColumn("range", F.floor(share * ranges))
    totals = dealt.groupBy("source", "range").agg(F.sum("size").alias("words"))
    earlier = Wd.partitionBy("source").orderBy("range").rowsBetween(Wd.unboundedPreceding, -1)
    totals = totals.withColumn("earlier", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    placed = dealt.join(totals, same(dealt, totals) & (dealt["range"] == totals["range"]), "left").drop(totals["source"]).drop(totals["range"])
    inside = Wd.partitionBy("source", "range").orderBy("digest", "doc_id").rowsBetween(Wd.unboundedPreceding, -1)
    before = F.col("earlier") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = placed.withColumn("before", before)
    whole = F.floor("target")
    taken = F.lit(0).cast("long")
    for i in range(MOST_PASSES):
        taken = taken + F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("before") - i * F.col("source_size")))
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("size")) / F.col("target"))
    out = placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), finish.alias("finish"), "digest")
    return out.orderBy("finish", "digest")


def report(docs: DataFrame, **more) -> DataFrame:
    """Per document in the order of the mix: doc_id, size, source_size, target, taken."""
    return mix(docs, **more).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
           md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, sum(size) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
      [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, cap, weight, max(level) FILTER (level * weight < cap) OVER () AS level FROM l),
g AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM t),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(greatest(0, least(size, floor(target) - earlier)) + greatest(0, least(size, floor(target) - earlier - source_size)) AS BIGINT) AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
"""


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents that the mix takes, in its order, with their columns and size, taken and finish instead of columns of these names.

    Rows meet their place by digest and source. Rows that share both are numbered, in the order of the rows as JSON, and
    the earlier places of the mix go to the smaller numbers.
    """
    kept = [c for c in docs.columns if c.lower() not in ("size", "taken", "finish")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    key, site, copy, at = fresh(docs, "key", "site", "copy", "at")
    placed = materialise(mix(docs, doc_id, source, text), "mix").select(F.col("digest").alias(key), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias(site), "size", "taken", "finish")
    keyed = docs.withColumns({key: _digest(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), site: F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))})
    repeated = materialise(placed.groupBy(key, site).count().where("count > 1").select(key, site), "repeated")
    if repeated.isEmpty():
        placed, keyed = placed.withColumn(copy, F.lit(1)), keyed.withColumn(copy, F.lit(1))
    else:
        near = F.broadcast(repeated.withColumn(at, F.lit(True))) if small(repeated, BROADCAST_ROWS) else repeated.withColumn(at, F.lit(True))

        def numbered(rows: DataFrame, *order: Column) -> DataFrame:
            found = rows.join(near, [key, site], "left")
            again = found.where(F.col(at)).withColumn(copy, F.row_number().over(Wd.partitionBy(key, site).orderBy(*order)))
            return found.where(F.col(at).isNull()).withColumn(copy, F.lit(1)).unionByName(again).drop(at)

        placed = numbered(placed, F.col("taken").desc(), F.col("finish"))
        keyed = numbered(keyed, F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept])))
    placed = materialise(placed.where("taken > 0"), "placed")
    joined = keyed.join(F.broadcast(placed) if small(placed, BROADCAST_ROWS) else placed, [key, site, copy])
    return joined.select(*[F.col(f"`{c}`") for c in kept], "size", "taken", "finish").orderBy("finish")
