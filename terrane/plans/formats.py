"""Queries that write a record format and read it back: what readers and writers make of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane import shared
from terrane.functions import text as T
from terrane.plans import stand_ins as S
from terrane.sources import readers, writers

_W = S.with_tables
TARGETS = ["1", " 1 ", "0", None]


def _pick(values: list, by):
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (by % len(values)).cast("int"))


def _digests(codes):
    """How often each text stands there."""
    return codes.groupBy(F.sha2("code", 256).alias("code_sha")).agg(F.count("*").alias("n"))


def baseline_csv(spark, d):
    """Texts as a generator's CSV table: processed_func for even documents, func for odd ones."""
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    even = F.col("doc_id") % 2 == 0
    table = docs.select(F.when(~even, F.col("text")).otherwise("other").alias("func"), F.when(even, F.col("text")).alias("processed_func"), _pick(TARGETS, F.col("doc_id")).alias("target"))
    path = shared.new_path(spark, "baseline")
    table.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return _digests(readers.READERS["vulgen"](spark, path))


def baseline_lines(field: str, approach: str):
    """Texts as a generator's JSON lines, with blank lines and lines that are cut off among them."""

    def run(spark, d):
        docs = S.table(spark, d, "documents").select("doc_id", "text")
        whole = F.to_json(F.struct(F.col("text").alias(field), "doc_id"))
        line = F.when(F.col("doc_id") % 7 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 13 == 0, F.lit('{"other": 1}')).otherwise(whole)
        path = shared.new_path(spark, "baseline")
        docs.select(line.alias("value")).write.text(path)
        return _digests(readers.READERS[approach](spark, [path]))

    return run


def folders(spark, d):
    """Texts as files below folders, read by their names' end."""
    path = shared.new_path(spark, "baseline")
    docs = S.table(spark, d, "documents").select("text", F.concat(F.col("doc_id") % 3, F.lit("_"), F.col("doc_id") % 2, F.lit(".c")).alias("name"))
    docs.groupBy("name").agg(F.count("*").cast("string").alias("value")).write.partitionBy("name").text(path)
    found = readers.c_files(spark, [path], "")
    return found.select(F.regexp_extract("path", "name=([^/]*)/", 1).alias("name"), F.trim(F.regexp_replace("code", "\n", "")).alias("n")).where(F.col("name").endswith("_1.c"))


def jsonl_round_trip(spark, d):
    path = shared.new_path(spark, "lines")
    n = writers.jsonl(S.table(spark, d, "documents").select("doc_id", "text"), path)
    back = readers.jsonl(spark, path, "doc_id long, text string")
    return back.select("doc_id", F.sha2("text", 256).alias("text_sha"), F.lit(n).alias("written"))


def detector_rows(spark, d):
    path = shared.new_path(spark, "detector")
    records = S.records(spark, d).where("target is not null")
    writers.detector_csv(records.select("code", F.col("target").alias("label")), path)
    back = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).csv(path)
    return back.groupBy(F.sha2("processed_func", 256).alias("code_sha"), F.col("target").cast("int").alias("target"), F.coalesce("flaw_line", F.lit("")).alias("flaw_line"), F.coalesce("flaw_line_index", F.lit("")).alias("flaw_line_index")).agg(F.count("*").alias("n"))


def appended(spark, d):
    """The iteration log appended in two parts, by family."""
    path = shared.new_path(spark, "log")
    archive = S.archive(spark, d)
    for part in range(2):
        writers.append(archive.where(F.col("seq") % 2 == part), path, "family")
    return spark.read.parquet(path).groupBy("family").agg(F.count("*").alias("samples"), F.sum("seq").alias("seqs"))


def exported(spark, d):
    """The archive as training records."""
    path = shared.new_path(spark, "export")
    archive = S.archive(spark, d).select(F.concat(F.lit("s"), F.col("seq").cast("string")).alias("id"), "seq", "cell_key", "family", F.concat(F.lit("int f"), F.col("seq").cast("string"), F.lit("();")).alias("code"))
    n = writers.export(archive, path)
    back = readers.jsonl(spark, path, "id string, code string, label int, family string, cell array<string>, source string")
    return back.select("id", "code", "label", "family", F.array_join("cell", "|").alias("cell_key"), "source", F.lit(n).alias("written"))


def vectors_round_trip(spark, d):
    """Vectors through the half-precision codec: the dimension and how far off the nearest number is at most."""
    coded = S.vectors(spark, d).select("seq", "embedding", writers.encoded_vectors(F.col("embedding")).alias("text"))
    back = coded.select("seq", "embedding", readers.archive_vectors(F.col("text")).alias("decoded"))
    near = F.forall(F.arrays_zip("embedding", "decoded"), lambda p: F.abs(p["embedding"] - p["decoded"]) <= F.abs(p["embedding"]) / 2048 + 1e-7)
    return back.select("seq", F.size("decoded").alias("dim"), near.alias("near"))


def sampled(spark, d):
    """A sample's rows beside how it was drawn."""
    path = shared.new_path(spark, "sample")
    docs = S.table(spark, d, "documents").select("doc_id")
    writers.sample_with_meta(docs, docs.count(), path, 3, "documents")
    meta = spark.read.json(f"{path}.meta")
    return meta.select("input", "available", "sampled", "seed", "method").withColumn("rows", F.lit(spark.read.json(path).count()))


def results_files(spark, d):
    """Result files by detector, training set, config and seed, and how many rows each has."""
    path = shared.new_path(spark, "results")
    runs = S.predictions(spark, d).groupBy("detector", "train_set", "config", "seed", "test_set").agg(F.count("*").alias("n"))
    writers.results(runs, path)
    return spark.read.json(path).select("detector", "train_set", "config", F.col("seed").cast("int").alias("seed"), "test_set", "n")


def literals(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    odd = F.concat(F.lit('a\\b"c\n'), F.col("text"))
    entries = F.array(F.struct(F.col("text").alias("key"), F.array(F.lit(0), F.lit(2)).alias("indexes")), F.struct(F.lit('q"').alias("key"), F.lit(None).cast("array<int>").alias("indexes")))
    return docs.select("doc_id", F.sha2(T.literal(odd), 256).alias("text_sha"), F.sha2(T.literal_set(F.array(F.col("text"), F.lit("x"))), 256).alias("set_sha"), F.sha2(T.literal_map(entries), 256).alias("map_sha"))


QUERIES = {
    "baseline_csv": baseline_csv,
    "baseline_generated_lines": baseline_lines("generated", "vulscriber"),
    "baseline_code_lines": baseline_lines("code", "gvi"),
    "baseline_folders": folders,
    "jsonl_round_trip": jsonl_round_trip,
    "detector_rows": detector_rows,
    "appended_archive": appended,
    "exported_records": exported,
    "vectors_round_trip": vectors_round_trip,
    "sample_meta": sampled,
    "results_files": results_files,
    "scala_literals": literals,
}
_SHA = "SELECT sha256({0}) AS code_sha, count(*) AS n FROM {1} GROUP BY 1"
_LINES = "(SELECT CASE WHEN doc_id % 13 = 0 THEN '' ELSE coalesce(text, '') END AS code FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0)"
_LIT = lambda x: f"chr(34) || replace(replace(replace({x}, '\\', '\\\\'), chr(34), '\\' || chr(34)), chr(10), '\\n') || chr(34)"
SQL = {
    "baseline_csv": _SHA.format("code", "(SELECT coalesce(text, CASE WHEN doc_id % 2 = 0 THEN 'other' ELSE '' END) AS code FROM documents WHERE doc_id % 4 <> 2)"),
    "baseline_generated_lines": _SHA.format("code", _LINES),
    "baseline_code_lines": _SHA.format("code", _LINES),
    "baseline_folders": "SELECT (doc_id % 3) || '_' || (doc_id % 2) || '.c' AS name, CAST(count(*) AS VARCHAR) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1",
    "jsonl_round_trip": "SELECT doc_id, sha256(text) AS text_sha, (SELECT count(*) FROM documents) AS written FROM documents",
    "detector_rows": f"{_W('records')} SELECT sha256(code) AS code_sha, target, '' AS flaw_line, '' AS flaw_line_index, count(*) AS n FROM records WHERE target IS NOT NULL GROUP BY 1, 2",
    "appended_archive": f"{_W('archive')} SELECT family, count(*) AS samples, CAST(sum(seq) AS BIGINT) AS seqs FROM archive GROUP BY family",
    "exported_records": f"{_W('archive')} SELECT 's' || seq AS id, 'int f' || seq || '();' AS code, 1 AS label, family, cell_key, 'synthetic' AS source, (SELECT count(*) FROM archive) AS written FROM archive",
    "vectors_round_trip": "SELECT vec_id AS seq, len(embedding) AS dim, true AS near FROM embeddings",
    "sample_meta": "SELECT 'documents' AS input, count(*) AS available, count(*) AS sampled, 3 AS seed, 'uniform without replacement' AS method, count(*) AS rows FROM documents",
    "results_files": f"{_W('predictions')} SELECT detector, train_set, config, seed, test_set, count(*) AS n FROM predictions GROUP BY ALL",
    "scala_literals": f"""SELECT doc_id, sha256({_LIT("'a' || chr(92) || 'b' || chr(34) || 'c' || chr(10) || text")}) AS text_sha, sha256('Set[String](' || {_LIT('text')} || ', ' || {_LIT("'x'")} || ')') AS set_sha,
        sha256('Map[String, List[Int]](' || {_LIT('text')} || ' -> List[Int](0, 2), ' || {_LIT("'q' || chr(34)")} || ' -> List[Int]())') AS map_sha FROM documents""",
}
