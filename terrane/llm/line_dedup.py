"""Line dedup by site-relative frequency. DataFrame functions only.

Pages are grouped by host. A line's frequency on a host is the number of pages that contain it over the host's number
of pages; lines above ``ratio`` that stand on ``min_pages`` pages or more are boilerplate and go from every page of
the host. Lines are compared without outer spaces; blank lines stay. Counting uses 64-bit fingerprints.

Scale: pages are scanned twice. The counting pass shuffles a fingerprint per distinct line and page, pre-aggregated;
keys are (host, line), so a hot host spreads. The lines that go are few per host: their frequencies sum to at most
the mean number of distinct lines per page, which bounds them by that mean over ``ratio``. They meet the pages by a
broadcast if their number is below a checked bound, and otherwise by a join on the host whose hot side Spark splits.
The pages' texts are rebuilt in place.

Defined cases: a null host is a host of its own; a null text has no lines and stays null; repeated rows are pages of
their own; a line at the ratio exactly stays; very long texts are taken whole; an empty table has no rows; extra columns,
whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, materialise, only_columns

RATIO = 0.02
MIN_PAGES = 5
BROADCAST_LINES = 1_000_000


def _site(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`").cast("string")), F.lit(""))


def _prints(text: str) -> Column:
    return F.transform(F.split(F.col(f"`{text}`"), "\n"), lambda line: F.xxhash64(F.trim(line)))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """``(_site, _gone)``: for each host that has any, the fingerprints of its boilerplate lines."""
    blank = F.xxhash64(F.lit(""))
    narrow = only_columns(pages, host, text).select(_site(host).alias("_site"), F.array_distinct(_prints(text)).alias("prints"))
    counts = narrow.select("_site", F.explode("prints").alias("print")).where(F.col("print") != blank)
    counts = counts.groupBy("_site", "print").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = narrow.groupBy("_site").agg(F.count("*").alias("total"))
    frequent = counts.join(totals, "_site").where(F.col("pages") > F.col("total") * F.lit(ratio))
    return frequent.groupBy("_site").agg(F.collect_set("print").alias("_gone"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``, and n_lines and n_dropped instead of columns of these names."""
    site, lost, kept = fresh(pages, "site", "gone", "kept")
    gone = materialise(boilerplate(pages, host, text, ratio, min_pages).toDF(site, lost), "boilerplate")
    lines = gone.agg(F.sum(F.size(lost))).first()[0] or 0
    joined = pages.withColumn(site, _site(host)).join(F.broadcast(gone) if lines <= BROADCAST_LINES else gone, site, "left")
    every = F.split(F.col(f"`{text}`"), "\n")
    none = F.col(lost).isNull()
    out = joined.withColumn(kept, F.when(none, every).otherwise(F.filter(every, lambda line: ~F.array_contains(lost, F.xxhash64(F.trim(line))))))
    left = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(kept)).cast("long")
    columns = [F.col(f"`{c}`") if c != text else F.when(none, F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n")).alias(text) for c in pages.columns if c.lower() not in names]
    n = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(every)).cast("long")
    return out.select(*columns, n.alias(names[0]), (n - left).alias(names[1]))


def report(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", **more) -> DataFrame:
    """Per page: doc_id, n_lines, n_dropped, n_chars and sha256 of the text that is left."""
    left = drop_boilerplate(only_columns(docs, doc_id, host, text), host, text, **more)
    return left.select(doc_id, "n_lines", "n_dropped", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


ORACLE_SQL = f"""
WITH page AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
line AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM page),
freq AS (SELECT source, trim(line, ' ') AS l, count(DISTINCT r) AS pages FROM line GROUP BY ALL),
total AS (SELECT source, count(*) AS total FROM page GROUP BY ALL),
gone AS (SELECT f.source, f.l FROM freq f JOIN total t ON f.source IS NOT DISTINCT FROM t.source
         WHERE l <> '' AND pages >= {MIN_PAGES} AND pages > total * CAST({RATIO} AS DOUBLE)),
left_over AS (SELECT line.r, count(*) AS n_lines, count(*) FILTER (g.l IS NOT NULL) AS n_dropped,
              coalesce(string_agg(line.line, chr(10) ORDER BY i) FILTER (g.l IS NULL), '') AS text
              FROM line LEFT JOIN gone g ON line.source IS NOT DISTINCT FROM g.source AND trim(line.line, ' ') = g.l GROUP BY line.r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       length(left_over.text) AS n_chars, sha256(left_over.text) AS text_sha256
FROM page LEFT JOIN left_over USING (r)
"""


def clean_lines(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **more) -> DataFrame:
    """``docs`` without boilerplate lines; ``n_chars`` follows where a line went."""
    names = tuple(fresh(docs, "n_lines", "n_dropped"))
    out = drop_boilerplate(docs, text=text, names=names, **more)
    length = F.when(F.col(names[1]) > 0, F.length(F.col(f"`{text}`")).cast("long")).otherwise(F.col(f"`{n_chars}`"))
    return out.withColumn(n_chars, length).drop(*names).select(*[F.col(f"`{c}`") for c in docs.columns])
