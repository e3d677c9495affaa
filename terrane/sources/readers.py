"""Readers of datasets, generator outputs, result files and tool reports as DataFrames.

Everything goes through Spark's file sources, so paths may be in any store that Spark reads. Archives are opened on
the executors from ``binaryFile`` rows.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import text as T

RECORD = "id string, func string, target int, cwe string, split string"
POOL = "id string, dataset string, split string, cwe string, family string, func string"
MEMORY = "family string, cell array<string>, failed_check string, diagnostic string, lesson string"
RESULT = (
    "detector string, train_set string, config string, seed int, aug string, n_train int, best_valid_f1 double, best_epoch int, selection string,"
    " test map<string, struct<precision: double, recall: double, f1: double, tp: int, fp: int, fn: int, n: int>>, hours double, hparams map<string, string>"
)
SARIF = (
    "runs array<struct<results: array<struct<ruleId: string, rule: struct<id: string>, message: struct<text: string>,"
    " locations: array<struct<physicalLocation: struct<region: struct<startLine: int>>>>>>>>"
)
FLOW = (
    "target_found boolean, sinks array<struct<code: string, line: int>>, sources array<struct<code: string, line: int>>, taint_edges int,"
    " flow array<struct<code: string, line: int>>, sink struct<code: string, line: int>, source struct<code: string, line: int>,"
    " structures array<struct<kind: string, line: int, code: string>>, predicates array<struct<code: string, line: int, refs_source: boolean>>"
)


def jsonl(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped and a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient_jsonl(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines; malformed ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def split(spark: SparkSession, root: str, dataset: str, name: str) -> DataFrame:
    """id, code, label, cwe and split of one file of a dataset."""
    rows = jsonl(spark, f"{root}/{dataset}/{name}.jsonl", RECORD)
    return rows.select("id", F.col("func").alias("code"), F.col("target").cast("int").alias("label"), "cwe", "split", F.lit(dataset).alias("dataset"))


def reference_pool(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, POOL)


def memory(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, MEMORY)


def results(spark: SparkSession, glob: str) -> DataFrame:
    """Result files as one row per test set, with its metrics."""
    runs = spark.read.schema(RESULT).option("multiLine", True).json(glob)
    return runs.select("detector", "train_set", "config", "seed", "aug", F.explode("test").alias("test_set", "m")).select("detector", "train_set", "config", "seed", "aug", "test_set", "m.*")


def published(spark: SparkSession, path: str, datasets: list[str]) -> DataFrame:
    """A wide results table as model, train, aug, test_set, metric, value."""
    from terrane.operators.metrics import results_long

    wide = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return results_long(wide, ["model", "train", "aug"], datasets, ["f1", "p", "r"])


def csv_functions(spark: SparkSession, paths) -> DataFrame:
    """code of rows whose target is 1 or isn't given, from processed_func or else func."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).csv(paths)
    have = set(rows.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    kept = rows.where(F.trim(F.coalesce(get("target"), F.lit("1"))) == "1") if "target" in have else rows
    return kept.select(F.coalesce(T.none_if_empty(get("processed_func")), T.none_if_empty(get("func")), F.lit("")).alias("code"))


def _members(suffixes: tuple[str, ...]):
    def entries(data: bytes, prefix: str) -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in sorted(z.namelist()):
                if name.endswith(suffixes):
                    yield prefix + name, z.read(name)
                elif name.endswith(".zip"):
                    yield from entries(z.read(name), f"{prefix}{name}!")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                for name, data in entries(content, ""):
                    yield pd.DataFrame({"path": [path], "member": [name], "text": [data.decode("utf-8", "replace")]})

    return read


def zip_members(spark: SparkSession, paths, *suffixes: str) -> DataFrame:
    """path, member, text of the archives' members with the suffixes; archives inside are opened too."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(_members(tuple(suffixes)), "path string, member string, text string")


def c_files(spark: SparkSession, paths: list[str], suffix: str = "_1.c") -> DataFrame:
    """path, code of the files (in folders or archives) with the suffix."""
    out = None
    for p in paths:
        if p.endswith(".zip"):
            part = zip_members(spark, p, suffix).select(F.concat_ws("!", "path", "member").alias("path"), F.col("text").alias("code"))
        else:
            files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(p)
            part = files.select(F.input_file_name().alias("path"), F.col("value").alias("code"))
        out = part if out is None else out.unionAll(part)
    return out


def well_formed(line: Column) -> Column:
    """Whether a line is one JSON value; the brackets keep the parser from stopping behind the first."""
    return F.try_parse_json(F.concat(F.lit("["), line, F.lit("]"))).isNotNull()


def json_field(spark: SparkSession, paths: list[str], field: str) -> DataFrame:
    """code from a field of JSON lines, of JSON lists (or ``{"data": [...]}``), or of lines in archives.

    A missing field is an empty text and a malformed line is left out.
    """
    out = None
    value = lambda c: F.coalesce(F.get_json_object(c, f"$.{field}"), F.lit(""))
    for p in paths:
        if p.endswith(".zip"):
            lines = zip_members(spark, p, ".jsonl").select(F.explode(F.split("text", "\r?\n")).alias("line"))
        elif p.endswith(".json"):
            whole = spark.read.option("wholetext", True).text(p).select(F.col("value").alias("doc"))
            data = F.when(F.ltrim("doc").startswith("["), F.col("doc")).otherwise(F.coalesce(F.get_json_object("doc", "$.data"), F.lit("[]")))
            lines = whole.select(F.explode(F.from_json(data, "array<string>")).alias("line"))
        else:
            lines = spark.read.text(p).select(F.col("value").alias("line"))
        good = lines.where((F.trim("line") != "") & well_formed(F.col("line")))
        part = good.select(value(F.col("line")).alias("code"))
        out = part if out is None else out.unionAll(part)
    return out


def _folder_or_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    if any(p.endswith(".zip") or not p.endswith(".csv") for p in paths):
        return c_files(spark, paths).select("code")
    return csv_functions(spark, paths)


#: Generator outputs by the approach that made them.
READERS: dict[str, Callable[[SparkSession, list[str]], DataFrame]] = {
    "vulgen": csv_functions,
    "vgx": _folder_or_table,
    "vulscriber": lambda spark, paths: json_field(spark, paths, "generated"),
    "gvi": lambda spark, paths: json_field(spark, paths, "code"),
}


def sarif_findings(reports: DataFrame, column: str = "sarif") -> DataFrame:
    """``reports`` flattened to query_id, message, line: one row per result, from its first location."""
    keep = [c for c in reports.columns if c != column]
    runs = reports.select(*keep, F.explode(F.from_json(column, SARIF)["runs"]).alias("_run")).select(*keep, F.explode("_run.results").alias("_r"))
    line = F.get(F.col("_r.locations"), F.lit(0))["physicalLocation"]["region"]["startLine"]
    rule = F.coalesce(T.none_if_empty(F.col("_r.ruleId")), F.col("_r.rule.id"), F.lit(""))
    return runs.select(*keep, rule.alias("query_id"), F.coalesce("_r.message.text", F.lit("")).alias("message"), F.coalesce(line, F.lit(0)).alias("line"))


def flow_analysis(text: Column) -> Column:
    """The struct of a flow report; one without the target has nothing else."""
    got = F.from_json(text, FLOW)
    return F.when(F.coalesce(got["target_found"], F.lit(False)), got).otherwise(F.from_json(F.lit('{"target_found": false}'), FLOW))


def query_files(spark: SparkSession, root: str, selectors: list[str]) -> DataFrame:
    """selector, path, query_id of the query files below each selector (a folder or a file)."""
    out = None
    for s in selectors:
        files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.ql").text(f"{root}/{s}")
        path = F.input_file_name()
        part = files.select(F.lit(s).alias("selector"), path.alias("path"), T.query_id(F.col("value"), path).alias("query_id"))
        out = part if out is None else out.unionAll(part)
    return out


def selector_queries(files: DataFrame) -> DataFrame:
    return files.groupBy("selector").agg(F.array_sort(F.collect_set("query_id")).alias("query_ids"))


def archive_vectors(encoded: Column) -> Column:
    """The floats of a base64 text of half-precision numbers."""

    @F.pandas_udf("array<float>")
    def decode(texts: pd.Series) -> pd.Series:
        import base64

        import numpy as np

        return texts.map(lambda t: None if t is None else np.frombuffer(base64.b64decode(t), np.float16).astype(np.float32))

    return decode(encoded)


ARCHIVE = (
    "id string, cell array<string>, descriptor map<string, string>, family string, target array<string>, stage string, mode string, rounds int,"
    " candidate struct<vulnerable: string, patched: string, context: string, target_name: string, language: string, fix_summary: string, generator: string, refiners: array<string>>,"
    " evidence string, variant string, embedding string"
)


def archive_log(spark: SparkSession, path: str) -> DataFrame:
    """An archive's log as id, cell_key, family, the candidate and its decoded vector."""
    rows = jsonl(spark, path, ARCHIVE)
    return rows.select("id", F.concat_ws("|", "cell").alias("cell_key"), "family", "target", "stage", "mode", "rounds", "candidate", archive_vectors(F.col("embedding")).alias("embedding"))


def family_tables(spark: SparkSession, families: dict[str, dict]) -> dict[str, DataFrame]:
    """A families' configuration as small tables: sinks, sources, queries and sanitizers."""
    sinks, sources, queries, sanitizers = [], [], [], []
    for family, c in families.items():
        for kind in ("sink_calls", "sink_operators"):
            sinks += [(family, kind, name, list(indexes)) for name, indexes in (c.get(kind) or {}).items()]
        for kind in ("source_calls", "dealloc_calls", "acquire_calls"):
            sources += [(family, kind, name) for name in c.get(kind) or []]
        queries += [(family, q) for q in c.get("codeql_queries") or []]
        if c.get("sanitizer"):
            sanitizers.append((family, c["sanitizer"], [e.lower() for e in c.get("sanitizer_errors") or []]))
    return {
        "sinks": spark.createDataFrame(sinks, "family string, kind string, name string, indexes array<int>"),
        "sources": spark.createDataFrame(sources, "family string, kind string, name string"),
        "queries": spark.createDataFrame(queries, "family string, selector string"),
        "sanitizers": spark.createDataFrame(sanitizers, "family string, sanitizer string, patterns array<string>"),
    }


def scheduler_state(text: str):
    from terrane.operators.schedule import State

    return State.from_json(json.dumps(json.loads(text)))
