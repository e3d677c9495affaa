"""Language identification by Bayesian evidence fusion.

For every language the log posterior of a row is the sum of

* the text's log likelihood under a byte-trigram model (ASCII folded, everything else but letters is a blank),
  divided by three since every byte stands in three trigrams;
* the log likelihood of the declared markup language, from counts of what rows of each language declare;
* the log likelihood of the address suffix, counted likewise;
* the log prior of the host, smoothed towards its registered domain, and that towards the whole collection.

The trigram model is fitted on a bounded sample of labelled rows: about ``SAMPLE_ROWS`` different texts of each language,
by a hash of the text whose threshold follows from the language's rows, so that every language that any row declares has
a model, however many rows there are. Hosts, domains, suffixes and declarations are grouped aggregates over all rows, of
the languages that the text alone gives.
A row is rejected ("und") if its text has no letters, if an even distribution over trigrams explains it better than
every language, or if no language reaches ``MIN_POSTERIOR``.

Scale: the texts are scored twice, by vectorised look-ups in a table of 2^14 trigrams per language (64 KB each, which is
what is broadcast), rather than kept or shuffled. A worker works through ``SEGMENT`` bytes of text at a time, so that its
memory follows neither the batch nor the longest text beyond their own bytes. The evidence tables have a row for each host; they meet the rows by a broadcast if their number is below
a checked bound, and otherwise by a join on the host whose hot side Spark splits.

Defined cases: a null or empty text is rejected; very long texts are read whole; of equal posteriors the first language
by name wins; a null host or declaration is a value of its own; repeated rows each get their row (and count once in the
model's sample); an empty table has no rows; without labelled rows everything is rejected; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import fresh, materialise, only_columns, opened, ship, small, threshold

SAMPLE_ROWS = 2000
BUCKETS = 1 << 14
SEGMENT = 1 << 18
MIN_POSTERIOR = 0.5
PRIOR_ROWS = 20.0
BROADCAST_HOSTS = 200_000
UNKNOWN = "und"


def _folding() -> np.ndarray:
    fold = np.full(256, 32, np.uint32)
    for lower in range(97, 123):
        fold[lower] = fold[lower - 32] = lower
    fold[128:] = np.arange(128, 256)
    return fold


_FOLD = _folding()


def _grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = _FOLD[data]
    blank = (b == 32).astype(np.uint8)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    keep = blank[:-2] + blank[1:-1] + blank[2:] < 2
    for back in (1, 2):
        edges = at[1:-1] - back
        keep[edges[(edges >= 0) & (edges < len(keep))]] = False
    where = np.flatnonzero(keep)
    bucket = (code[where] * np.uint32(2654435761)) >> np.uint32(32 - 14)
    return bucket, np.searchsorted(where, at)


def segments(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The trigrams that aren't mostly blank by about ``SEGMENT`` bytes of text: a first row, the trigrams' buckets in order
    and where those of that row and of the next ones start. A longer row goes on in the next segments.
    """
    data, at = W.utf8(column)
    lo = 0
    while lo < len(data):
        row = int(np.searchsorted(at, lo, "right")) - 1
        last = int(np.searchsorted(at, lo + SEGMENT, "right")) - 1
        whole = last > row
        last = last if whole else row + 1
        hi = end = int(at[last])
        if not whole and hi > lo + SEGMENT:
            hi = lo + SEGMENT
            end = min(end, hi + 2)
        if end - lo > 2:
            yield row, *_grams(data[lo:end], np.clip(at[row : last + 1], lo, end) - lo)
        lo = hi


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every row's trigrams that aren't mostly blank, in order, and where each row's start."""
    found, n = [np.zeros(0, np.int64)], np.zeros(len(column), np.int64)
    for row, bucket, at in segments(column):
        found.append(bucket)
        n[row : row + len(at) - 1] += np.diff(at)
    return np.concatenate(found), np.concatenate([[0], np.cumsum(n)])


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.pieces(batches, 0):
        lang = np.array(batch.column(1), dtype=np.int64)
        parts = [np.unique(np.repeat(lang[row : row + len(at) - 1], np.diff(at)) * BUCKETS + bucket, return_counts=True) for row, bucket, at in segments(batch.column(0))]
        if parts:
            distinct, where = np.unique(np.concatenate([both for both, _ in parts]), return_inverse=True)
            n = np.zeros(len(distinct), np.int64)
            np.add.at(n, where, np.concatenate([counts for _, counts in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(distinct // BUCKETS), pa.array(distinct % BUCKETS), pa.array(n)], names=["lang", "gram", "n"])


class Model:
    """Languages and their log trigram probabilities."""

    def __init__(self, languages: list[str], log_p: np.ndarray) -> None:
        self.languages, self.log_p = languages, log_p

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each row under each language, the even distribution last; and the rows' trigrams."""
        n = np.zeros(len(column), np.int64)
        out = np.zeros((len(column), len(self.languages) + 1))
        for first, bucket, at in segments(column):
            here = np.diff(at)
            n[first : first + len(here)] += here
            rows = np.flatnonzero(here)
            if len(rows):
                for i, log_p in enumerate(self.log_p):
                    out[first + rows, i] += np.add.reduceat(log_p[bucket], at[:-1][rows], dtype=np.float64)
        out[:, -1] = n * -np.log(BUCKETS)
        return out / 3, n


def fit(labelled: DataFrame, text: str, lang: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A trigram model from a bounded sample of each language's rows with text and language."""
    rows = only_columns(labelled, text, lang).toDF("text", "lang").where("text is not null and lang is not null")
    sizes = sorted((r.lang, r["count"]) for r in rows.groupBy("lang").count().collect())
    languages = [name for name, _ in sizes]
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        limits = labelled.sparkSession.createDataFrame([(name, i, threshold(sample_rows, n)) for i, (name, n) in enumerate(sizes)], "lang string, number long, most long")
        drawn = F.shiftrightunsigned(F.xxhash64("text", F.lit(1)), 1) <= F.col("most")
        sample = rows.join(F.broadcast(limits), "lang").where(drawn).select("text", "number").distinct()
        counted = sample.mapInArrow(_counter, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
        counts[np.array(counted.column("lang")), np.array(counted.column("gram"))] = np.array(counted.column("n"))
    p = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    return Model(languages, np.log(p).astype(np.float32))


def _texts(shipped):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(shipped) as m:
            for batch in W.pieces(batches, "text"):
                scores, n = m.scores(batch.column("text"))
                top = scores.argmax(axis=1)
                names = [m.languages[i] if i < len(m.languages) and k else None for i, k in zip(top.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("site"), batch.column("suffix"), batch.column("declared"), pa.array(names, pa.string())], names=["site", "suffix", "declared", "best"])

    return best


def _fuser(shipped, declared: dict[str, list[float]], n_keep: int, body: int, made: tuple[str, str]):
    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(shipped) as m:
            none = np.full(len(m.languages), -np.log(max(1, len(m.languages))))
            other = {k: np.array(v) for k, v in declared.items()}
            for batch in W.pieces(batches, body):
                scores, n = m.scores(batch.column(body))
                known = scores[:, :-1].copy()
                if len(m.languages):
                    priors = batch.column(0).to_pylist()
                    known += np.array([none if p is None else p for p in priors]).reshape(known.shape)
                    known += np.array([other.get(x, none) for x in batch.column(1).to_pylist()]).reshape(known.shape)
                    top = known.argmax(axis=1)
                    posterior = 1 / np.exp(known - known.max(axis=1, keepdims=True)).sum(axis=1)
                    rows = np.arange(len(top))
                    fine = (n > 0) & (scores[rows, top] > scores[:, -1]) & (posterior >= MIN_POSTERIOR)
                    names = [m.languages[i] if ok else UNKNOWN for i, ok in zip(top.tolist(), fine.tolist(), strict=True)]
                else:
                    posterior, names = np.zeros(len(n)), [UNKNOWN] * len(n)
                kept = [batch.column(i) for i in range(2, 2 + n_keep)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(posterior)], names=[*batch.schema.names[2 : 2 + n_keep], *made])

    return fuse


def _log_likelihoods(counts: DataFrame, by: str, languages: list[str]) -> DataFrame:
    """``(by, evidence)``: log P(value | language) for each language, smoothed by one row spread over the values."""
    per = [F.sum(F.when(F.col("best") == l, F.col("n")).otherwise(0)).alias(f"c{i}") for i, l in enumerate(languages)]
    table = counts.groupBy(by).agg(*per)
    values, *totals = table.agg(F.count("*"), *[F.sum(f"c{i}") for i in range(len(languages))]).first()
    logs = [F.log((F.col(f"c{i}") + 1 / max(1, values)) / ((total or 0) + 1.0)) for i, total in enumerate(totals)]
    return table.select(by, F.array(*logs).alias("evidence"))


def identify(rows: DataFrame, model: Model, text: Column | str, host: Column, declared: Column, names: tuple[str, str] = ("detected", "posterior")) -> DataFrame:
    """``rows`` with detected (a language or "und") and posterior. ``text``, ``host``, ``declared``: columns of ``rows``.

    Columns of ``rows`` that have these ``names`` are replaced. A ``text`` given by its name goes to the workers once, with
    the columns that stay; another column goes there besides them.
    """
    kept = [c for c in rows.columns if c.lower() not in names]
    same = [i for i, c in enumerate(kept) if isinstance(text, str) and c.lower() == text.lower()]
    text = F.col(f"`{text}`") if isinstance(text, str) else text
    spark = rows.sparkSession
    languages = model.languages
    at, prior, body, saying = fresh(rows, "_site", "_prior", "_text", "_declared")
    shipped = ship(spark, model)
    name = F.lower(F.trim(host))
    site = F.coalesce(F.concat(F.lit("="), name), F.lit(""))
    suffix = F.coalesce(F.when(F.instr(name, ".") > 0, F.element_at(F.split(name, r"\."), -1)), F.lit(""))
    primary = F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), "^\\s*([A-Za-z]+)", 1))
    says = F.when(primary.isin(languages), primary).when(primary == "", F.lit("")).otherwise(F.lit("?")) if languages else F.lit("")
    out = rows
    if languages:
        narrow = rows.select(site.alias("site"), suffix.alias("suffix"), says.alias("declared"), text.alias("text"))
        best = narrow.mapInArrow(_texts(shipped), "site string, suffix string, declared string, best string").where("best is not null")
        counts = materialise(best.groupBy("site", "suffix", "declared", "best").agg(F.count("*").alias("n")), "evidence")
        whole = {r.best: r.n for r in counts.groupBy("best").agg(F.sum("n").alias("n")).collect()}
        total = sum(whole.values()) + len(languages)
        overall = [(whole.get(l, 0) + 1) / total for l in languages]
        says_table = {r.declared: r.evidence for r in _log_likelihoods(counts, "declared", languages).collect()}
        domain = F.when(F.col("site").contains("."), F.array_join(F.slice(F.split("site", r"\."), -2, 2), ".")).otherwise(F.col("site"))
        domain = F.regexp_replace(domain, "^=", "")
        per = [F.sum(F.when(F.col("best") == l, F.col("n")).otherwise(0)).alias(f"c{i}") for i, l in enumerate(languages)]
        by_site = counts.groupBy("site", "suffix").agg(*per, F.sum("n").alias("all")).withColumn("domain", domain)
        by_domain = by_site.groupBy("domain").agg(*[F.sum(f"c{i}").alias(f"d{i}") for i in range(len(languages))], F.sum("all").alias("d_all"))
        in_domain = [(F.col(f"d{i}") + PRIOR_ROWS * overall[i]) / (F.col("d_all") + PRIOR_ROWS) for i in range(len(languages))]
        on_site = [F.log((F.col(f"c{i}") + PRIOR_ROWS * in_domain[i]) / (F.col("all") + PRIOR_ROWS)) for i in range(len(languages))]
        with_domain = by_site.join(by_domain, "domain").withColumn("host_prior", F.array(*on_site))
        by_suffix = _log_likelihoods(counts, "suffix", languages)
        sites = with_domain.join(by_suffix, "suffix").select(F.col("site").alias(at), F.zip_with("host_prior", "evidence", lambda a, b: a + b).alias(prior))
        sites = materialise(sites, "hosts")
        out = rows.withColumn(at, site).join(F.broadcast(sites) if small(sites, BROADCAST_HOSTS) else sites, at, "left")
    else:
        says_table = {}
        out = out.withColumn(prior, F.lit(None).cast("array<double>"))
    besides = [] if len(same) == 1 else [text.alias(body)]
    ready = out.select(F.col(prior), says.alias(saying), *[F.col(f"`{c}`") for c in kept], *besides)
    schema = rows.select(*[F.col(f"`{c}`") for c in kept]).withColumns({names[0]: F.lit("").cast("string"), names[1]: F.lit(0.0)}).schema
    return ready.mapInArrow(_fuser(shipped, says_table, len(kept), 2 + (len(kept) if besides else same[0]), names), schema)


_SKIPPED = r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^>]*(?:>|\z)"


def visible_text(html: Column) -> Column:
    return F.regexp_replace(html, _SKIPPED, " ")


def of_pages(pages: DataFrame, labelled: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, declared, detected, posterior."""
    rows = only_columns(pages, page_id, url, html).toDF("page_id", "url", "html")
    page, page_id, url, html = page_id, "page_id", "url", "html"
    declared = F.nullif(F.regexp_extract(F.col(html), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", 1), F.lit(""))
    rows = rows.withColumn("declared", declared).withColumn("_visible", visible_text(F.col(html)))
    rows = rows.select(page_id, "declared", F.regexp_extract(F.col(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1).alias("_host"), "_visible")
    rows = rows.withColumn("_host", F.nullif("_host", F.lit("")))
    found = identify(rows, fit(labelled, "text", "lang"), "_visible", F.col("_host"), F.col("declared"))
    return found.select(F.col("page_id").alias(page), "declared", "detected", "posterior")


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that aren't rejected; ``lang`` is what they declare and ``source`` their host."""
    names = tuple(fresh(docs, "detected", "posterior"))
    found = identify(docs, fit(docs, text, lang), text, F.col(f"`{source}`"), F.col(f"`{lang}`"), names)
    return found.where(F.col(names[0]) != UNKNOWN).drop(*names)
