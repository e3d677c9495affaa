"""Users' columns that are named like an operator's own stay as they are; workers need no copy of the package."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from terrane.llm import ann, decontam, langid, license_scan, line_dedup, mixing, neardup, secrets, toxicity, warc

OWN = ["site", "gone", "kept", "prior", "text_", "declared", "key", "which", "copy", "at", "digest", "rank", "hits", "items", "words", "worth", "lower", "found", "prints", "total", "pages", "node", "label", "members", "id", "vid", "code", "query", "part", "value", "member", "payload", "toxic", "aside", "unit", "features", "n_words", "range", "earlier", "before", "target"]
NAMES = [*OWN, *[f"_{n}" for n in OWN], "_site", "__site", "_text", "_digest", "_source"]


def table(spark):
    """Some documents with a column of every internal name, which holds the name and the row."""
    rows = [(i, f"a{i % 3}", "en", f"menu\nthe of and to in that is number {i % 7} released under the mit license password=abcdefgh{i % 7}", 10) for i in range(30)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, n_chars long")
    # A column's name may differ from another's in case alone.
    names = list({n.lower(): n for n in NAMES}.values())
    return docs.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names if n not in docs.columns}), names


OPERATORS = {
    "keep_known": (lambda s, d: langid.keep_known(d), ()),
    "clean_lines": (lambda s, d: line_dedup.clean_lines(d, ratio=0.9, min_pages=2), ()),
    "keep_one": (lambda s, d: neardup.keep_one(d), ()),
    "remove": (lambda s, d: decontam.remove(d, s.createDataFrame([(1, "no such words anywhere")], "item_id long, text string")), ()),
    "cut_spans": (lambda s, d: decontam.cut_spans(d, s.createDataFrame([(1, "menu the of")], "item_id long, text string"), min_words=2, min_coverage=0.9), ()),
    "mixed_documents": (lambda s, d: mixing.mixed_documents(d), ()),
    "license_scan": (lambda s, d: license_scan.scan(d), ("n_words", "found")),
    "secret_scan": (lambda s, d: secrets.scan(d), ("found",)),
    "toxicity": (lambda s, d: toxicity.score(d, None), ()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_stay(spark, name):
    docs, names = table(spark)
    run, made = OPERATORS[name]
    out = run(spark, docs)
    own = [n for n in names if n not in made]
    rows = out.select("doc_id", *[F.col(f"`{n}`") for n in own]).collect()
    assert rows and all(r[i + 1] == f"{n}{'-' if r.doc_id is None else r.doc_id}" for r in rows for i, n in enumerate(own))


REPORTS = {
    "op1": lambda s, d: decontam.report(d, s.createDataFrame([(1, "menu the of")], "item_id long, text string")),
    "op4": lambda s, d: license_scan.report(d),
    "op6": lambda s, d: mixing.report(d),
    "op9": lambda s, d: line_dedup.report(d),
    "op10": lambda s, d: secrets.report(d),
    "op3": lambda s, d: langid.of_pages(d.withColumns({"page_id": F.col("doc_id"), "url": F.lit("http://a.b/"), "html": F.col("text")}), d),
    "op5": lambda s, d: ann.search(d.withColumns({"vec_id": F.col("doc_id"), "embedding": F.array(F.lit(1.0), F.col("doc_id").cast("double"))}), F.col("vec_id") % 10 == 0),
    "op7": lambda s, d: warc.round_trip(d.withColumns({"page_id": F.col("doc_id"), "url": F.lit("u"), "html": F.col("text")})),
    "op8": lambda s, d: toxicity.report(d, s.createDataFrame([(i, i % 2, "x") for i in range(20)], "doc_id long, toxic int, text string")),
}


@pytest.mark.parametrize("name", REPORTS)
def test_reports_ignore_other_columns(spark, name):
    docs, _ = table(spark)
    plain = docs.select("doc_id", "source", "lang", "text", "n_chars")
    got, want = (sorted(map(repr, (tuple(r) for r in REPORTS[name](spark, d).collect()))) for d in (docs, plain))
    assert got == want and got


ALONE = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def absent(batches):
    import importlib.util
    assert importlib.util.find_spec("terrane") is None
    yield from batches
spark.range(1).mapInArrow(absent, "id long").collect()
sys.path.insert(0, sys.argv[1])
from terrane.llm import ann, decontam, langid, neardup, toxicity, warc
docs = spark.createDataFrame([(i, "x.y", "en", f"the of and to in that number {i % 4}") for i in range(20)], "doc_id long, source string, lang string, text string")
items = spark.createDataFrame([(1, "the of and")], "item_id long, text string")
assert decontam.report(docs, items).where("contaminated").count() == 20
assert langid.keep_known(docs).count() == 20
assert neardup.keep_one(docs).count() == 4
labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
assert toxicity.report(docs, labels).count() == 20
vectors = spark.createDataFrame([(i, [1.0, float(i), 2.0]) for i in range(20)], "vec_id long, embedding array<double>")
assert ann.search(vectors, F.col("vec_id") % 10 == 0).count() == 10
pages = docs.selectExpr("doc_id AS page_id", "source AS url", "text AS html")
assert warc.round_trip(pages).count() == 20
print("ALONE")
"""


def test_workers_without_the_package(tmp_path):
    script = tmp_path / "alone.py"
    script.write_text(ALONE)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, str(script), repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ALONE" in done.stdout, done.stderr[-3000:]
