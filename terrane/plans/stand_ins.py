"""The driver's tables as the engine's record types: one mapping for Spark and the same in SQL.

documents with labels are dataset records, events the iteration log and the archive, embeddings archived vectors,
conversations refinement rounds, lineitem predictions and runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import atlas

CWES = ["CWE-119", " cwe-125 ", "787", "CWE-476", "CWE-415", "CWE416", "CWE-190", "CWE-191", "CWE-77", "CWE-78", "CWE-89", "CWE-22", "CWE-401", "CWE-404", "CWE-369", "CWE-134", "CWE-79", None]
MODELS = ["alpha", "beta", "gamma"]
FAILED = ["syntax", "weakness", "characterization", "diversity", "accepted"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """id, seq, code, target, split, cwe."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    cwe = F.get(F.array(*[F.lit(c) for c in CWES]), (F.col("doc_id") % 18).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.col("doc_id").alias("seq"),
        F.col("text").alias("code"),
        F.col("quality").cast("int").alias("target"),
        F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"),
        cwe.alias("cwe"),
    )


def cells(spark: SparkSession) -> DataFrame:
    """The admissible cells with a dense ordinal."""
    from pyspark.sql import Window

    return atlas.cells(spark).withColumn("ordinal", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("position")) - 1)


def log(spark: SparkSession, d: str) -> DataFrame:
    """iteration, stage, target_key, accepted, cell_key, family: the iteration log."""
    grid = F.broadcast(cells(spark).select("ordinal", "cell_key", "d1"))
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    e = e.withColumns({"_t": (F.col("event_id") * F.col("event_id") + F.col("user_id")) % 936, "_c": (F.col("event_id") * 31 + F.col("user_id")) % 936})
    target = grid.select(F.col("ordinal").alias("_t"), F.col("cell_key").alias("target_key"))
    got = grid.select(F.col("ordinal").alias("_c"), "cell_key", F.col("d1").alias("family"))
    e = e.join(target, "_t").join(got, "_c")
    accepted = F.coalesce(F.col("value") > 60, F.lit(False))
    return e.select(
        F.col("event_id").alias("iteration"), F.col("event_type").alias("stage"), "target_key", accepted.alias("accepted"), F.when(accepted, F.col("cell_key")).alias("cell_key"), F.when(accepted, F.col("family")).alias("family")
    )


def archive(spark: SparkSession, d: str) -> DataFrame:
    """seq, cell_key, family: the accepted samples."""
    return log(spark, d).where("accepted").select(F.col("iteration").alias("seq"), "cell_key", "family")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), F.col("label").alias("cell_key"), "embedding")


def rounds(spark: SparkSession, d: str) -> DataFrame:
    """run, round, stage, model."""
    c = table(spark, d, "conversations").select("conv_id", "turn")
    model = F.get(F.array(*[F.lit(m) for m in MODELS]), ((F.col("conv_id") + F.col("turn") * 2) % 3).cast("int"))
    stage = F.get(F.array(*[F.lit(s) for s in FAILED]), ((F.col("conv_id") * 7 + F.col("turn") * 3) % 5).cast("int"))
    return c.select(F.col("conv_id").alias("run"), F.col("turn").alias("round"), stage.alias("stage"), model.alias("model"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """detector, train_set, config, seed, test_set, label, pred."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_tax")
    pick = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))
    return line.select(
        F.col("l_returnflag").alias("detector"),
        pick(TRAIN, F.col("l_orderkey")).alias("train_set"),
        pick(CONFIGS, F.col("l_partkey")).alias("config"),
        F.col("l_linenumber").alias("seed"),
        pick(TRAIN, F.floor(F.col("l_orderkey") / 4)).alias("test_set"),
        (F.col("l_linestatus") == "F").cast("int").alias("label"),
        (F.col("l_discount") + F.col("l_tax") >= 0.09).cast("int").alias("pred"),
    )


TRAIN = ["megavul", "primevul", "icvul", "titanvul"]
CONFIGS = ["orig", "ours", "a", "b", "c", "d"]


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


_FAMILY_ROWS = ", ".join(f"('{f}', '{display}', {cwe})" for f, (display, cwes) in atlas.FAMILIES.items() for cwe in cwes)
_DIM = {d: "(SELECT i - 1 AS o, v FROM (SELECT unnest(range(1, {n} + 1)) AS i, unnest({l}) AS v))".format(n=len(v), l=_list(v)) for d, v in atlas.VALUES.items()}

#: Common table expressions with the names of the functions above.
SQL = {
    "family": f"family AS (SELECT * FROM (VALUES {_FAMILY_ROWS}) t(family, display, cwe))",
    "records": f"""records AS (SELECT 'd' || d.doc_id AS id, d.doc_id AS seq, d.text AS code, CAST(l.quality AS INT) AS target,
        CASE WHEN d.doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, {_list(CWES)}[1 + d.doc_id % 18] AS cwe
        FROM documents d LEFT JOIN labels l USING (doc_id))""",
    "grid": f"""grid AS (SELECT d1.v AS d1, d2.v AS d2, d3.v AS d3, d4.v AS d4, d5.v AS d5,
        (((d1.o * 4 + d2.o) * 5 + d3.o) * 2 + d4.o) * 3 + d5.o AS position,
        NOT ((d1.v = 'use_after_free' AND d2.v = 'zero') OR (d3.v IN ('linear', 'exception') AND d4.v = 'guarded')) AS admissible
        FROM {_DIM['d1']} d1, {_DIM['d2']} d2, {_DIM['d3']} d3, {_DIM['d4']} d4, {_DIM['d5']} d5)""",
    "cells": """cells AS (SELECT *, d1 || '|' || d2 || '|' || d3 || '|' || d4 || '|' || d5 AS cell_key,
        row_number() OVER (ORDER BY position) - 1 AS ordinal FROM grid WHERE admissible)""",
    "edges": """edges AS (SELECT a.cell_key AS src_key, b.cell_key AS dst_key,
        CASE WHEN a.d1 <> b.d1 THEN 'd1' WHEN a.d2 <> b.d2 THEN 'd2' WHEN a.d3 <> b.d3 THEN 'd3' WHEN a.d4 <> b.d4 THEN 'd4' ELSE 'd5' END AS dim
        FROM cells a, cells b WHERE (a.d1 <> b.d1)::INT + (a.d2 <> b.d2)::INT + (a.d3 <> b.d3)::INT + (a.d4 <> b.d4)::INT + (a.d5 <> b.d5)::INT = 1)""",
    "log": """log AS (SELECT e.event_id AS iteration, e.event_type AS stage, t.cell_key AS target_key, coalesce(e.value > 60, false) AS accepted,
        CASE WHEN e.value > 60 THEN c.cell_key END AS cell_key, CASE WHEN e.value > 60 THEN c.d1 END AS family
        FROM events e JOIN cells t ON t.ordinal = (e.event_id * e.event_id + e.user_id) % 936 JOIN cells c ON c.ordinal = (e.event_id * 31 + e.user_id) % 936)""",
    "archive": "archive AS (SELECT iteration AS seq, cell_key, family FROM log WHERE accepted)",
    "rounds": f"rounds AS (SELECT conv_id AS run, turn AS round, {_list(FAILED)}[1 + (conv_id * 7 + turn * 3) % 5] AS stage, {_list(MODELS)}[1 + (conv_id + turn * 2) % 3] AS model FROM conversations)",
    "predictions": f"""predictions AS (SELECT l_returnflag AS detector, {_list(TRAIN)}[1 + l_orderkey % 4] AS train_set, {_list(CONFIGS)}[1 + l_partkey % 6] AS config,
        l_linenumber AS seed, {_list(TRAIN)}[1 + (l_orderkey // 4) % 4] AS test_set, CAST(l_linestatus = 'F' AS INT) AS label, CAST(l_discount + l_tax >= 0.09 AS INT) AS pred FROM lineitem)""",
}
_NEEDS = {"cells": ["grid"], "edges": ["grid", "cells"], "log": ["grid", "cells"], "archive": ["grid", "cells", "log"]}


def with_tables(*names: str) -> str:
    """``WITH`` and the expressions that the names need, in order."""
    wanted = {n for name in names for n in [*_NEEDS.get(name, []), name]}
    return "WITH " + ",\n".join(sql for name, sql in SQL.items() if name in wanted)
