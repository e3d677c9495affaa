"""Approximate nearest neighbours by multi-index hashing.

Vectors are rotated by a learned rotation (principal axes, then iterative quantisation: alternate between the signs
and the orthogonal map that fits them best) and coded by their signs. Vectors of few dimensions are first lifted by
several independent rotations, so that a code has ``BITS`` bits. Each code is cut into m substrings, each of which is
indexed. A code within Hamming distance r of a query's differs in at least one substring by at most floor(r / m) bits,
so probing the buckets within that distance of each of the query's substrings retrieves every code within the radius;
these are checked whole, and the ones that pass are reranked by cosine of the original vectors in double precision.

The radius widens query by query:

* First the index is a table of (substring, value, vector), shuffled by substring and value; each query's probes of up
  to ``WITHIN`` flipped bits join it. That covers a radius of m (WITHIN + 1) - 1. A query is finished if it found
  enough and whatever is nearer than the last of these has its code inside that radius (its expected Hamming distance
  and ``MARGIN`` standard deviations). Substrings follow the logarithm of the rows, so that buckets stay small. A bucket
  of more than ``BUCKET_ROWS`` rows (a large group of near copies has one in each substring) isn't joined: a query that
  probes one leaves the join with all of its probes and is answered with the following ones.
* Queries without neighbours so near would probe most buckets of any table, each row once per substring. They go out
  in blocks, to indexes of up to ``INDEX_ROWS`` rows that stay where the rows are, which are probed within the radius
  that holds ``TARGET`` of a sample's true neighbours. Those that find too few there are sent again with twice the
  radius, up to all bits, which is exact.

Scale: equal vectors are one row of the index with the smallest of their vec_ids, and each brings no more than
k + 1 of them into a result; a vector that a third of all rows share costs one row. The join of near queries makes no
more than ``BUCKET_ROWS`` rows per probe, so that its rows grow with the queries and not with the square of a group. The
rotation and radius are fitted on a bounded sample (``SAMPLE_ROWS`` vectors by hash); the index holds every row. A block
is at most ``QUERY_BLOCK`` queries, and neither its vectors nor an index's take more than ``BLOCK_BYTES``; the driver
holds and ships one at a time and takes it back once its results are written. What a block shuffles is k + 1 rows per
query and index.

Defined cases: vectors that are null, zero or hold null or non-finite components, or whose length isn't the
commonest one (of those the smallest), take no part; rows that share a vec_id are one, with the least of their vectors
that take part; ties go to the smaller vec_id; rows without vec_id take no part; vectors of any length up to memory; an
empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from .scratch import drawn, materialise, new_path, only_columns, opened, ship

BITS = 256
SAMPLE_ROWS = 4000
SAMPLE_QUERIES = 200
TARGET = 0.99
WITHIN = 1
BUCKET_ROWS = 256
MARGIN = 3.0
INDEX_ROWS = 1 << 16
QUERY_BLOCK = 8192
BLOCK_BYTES = 64 << 20
ROUNDS = 20


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by powers of two first, which is exact and keeps squares in range."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    scaled = np.ldexp(vectors, -exponent[:, None])
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Coder:
    """Learned rotations and the radius."""

    def __init__(self, sample: np.ndarray, k: int) -> None:
        unit = units(sample)
        self.dim = unit.shape[1]
        self.mean = unit.mean(axis=0)
        centred = unit - self.mean
        axes = np.linalg.svd(centred.T @ centred)[0]
        copies = max(1, -(-BITS // self.dim))
        rnd = np.random.default_rng(11)
        turns = []
        for _ in range(copies):
            turn = np.linalg.qr(rnd.normal(size=(self.dim, self.dim)))[0]
            projected = centred @ axes
            for _ in range(ROUNDS):
                left, _, right = np.linalg.svd(projected.T @ np.where(projected @ turn > 0, 1.0, -1.0))
                turn = left @ right
            turns.append(axes @ turn)
        self.turn = np.concatenate(turns, axis=1)
        self.bits = -(-self.turn.shape[1] // 64) * 64
        self.radius = self.bits
        if len(unit) > k + 1:
            codes = self.codes(sample)
            queries = np.arange(0, len(unit), max(1, len(unit) // SAMPLE_QUERIES))[:SAMPLE_QUERIES]
            near = unit[queries] @ unit.T
            near[np.arange(len(queries)), queries] = -np.inf
            best = np.argpartition(-near, k, axis=1)[:, :k]
            far = np.bitwise_count(codes[queries][:, None, :] ^ codes[best]).sum(axis=2, dtype=np.int64)
            self.radius = int(np.quantile(far, TARGET))

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of 64-bit words."""
        signs = np.zeros((len(vectors), self.bits), np.uint8)
        signs[:, : self.turn.shape[1]] = (units(vectors) - self.mean) @ self.turn > 0
        return np.packbits(signs, axis=1, bitorder="little").view(np.uint64)


class MultiIndex:
    """Tables of some rows by each 16-bit substring of their codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.parts = codes, codes.view(np.uint16)
        self.tables = []
        for j in range(self.parts.shape[1]):
            order = np.argsort(self.parts[:, j], kind="stable")
            values, first = np.unique(self.parts[order, j], return_index=True)
            self.tables.append((values, order, np.diff(np.concatenate([first, [len(order)]]))))

    def retrieve(self, query: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within ``radius`` of the query's, by the buckets that hold one by the pigeonhole."""
        probed = np.zeros(len(self.codes), bool)
        within = radius // len(self.tables)
        for part, (values, order, n) in zip(query.view(np.uint16), self.tables, strict=True):
            hit = np.bitwise_count(values ^ part) <= within
            probed[order[np.repeat(hit, n)]] = True
            if probed.all():
                break
        rows = np.flatnonzero(probed)
        return rows[np.bitwise_count(self.codes[rows] ^ query).sum(axis=1, dtype=np.int64) <= radius]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.array(column.flatten(), dtype=float).reshape(len(column), dim)


def _coder(shipped, n: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(shipped) as coder:
            for batch in batches:
                if batch.num_rows:
                    words = coder.codes(_matrix(batch.column(1), coder.dim))
                    offsets = pa.array(np.arange(len(words) + 1, dtype=np.int32) * n)
                    lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(words).view(np.int64).ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vid", "vector", "code"])

    return code


def _cosines(dim: int):
    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (units(_matrix(batch.column(i), dim)) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a * b).sum(axis=1))], names=["query", "vid", "score"])

    return cosines


def _fitting(rows: int, dim: int) -> int:
    """As many of ``rows`` vectors as ``BLOCK_BYTES`` hold."""
    return max(1, min(rows, BLOCK_BYTES // (8 * dim)))


def _searcher(shipped, radius: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(shipped) as (query_ids, queries, query_codes):
            query_units = units(queries)
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= _fitting(INDEX_ROWS, query_units.shape[1]):
                    yield answer(held, query_ids, query_units, query_codes)
                    held, n = [], 0
            if n:
                yield answer(held, query_ids, query_units, query_codes)

    def answer(held: list[pa.RecordBatch], query_ids, query_units, query_codes) -> pa.RecordBatch:
        ids = np.concatenate([np.array(b.column(0)) for b in held])
        own = units(np.concatenate([_matrix(b.column(1), query_units.shape[1]) for b in held]))
        index = MultiIndex(np.concatenate([np.array(b.column(2).flatten(), dtype=np.int64).view(np.uint64).reshape(b.num_rows, -1) for b in held]))
        out_q, out_v, out_s = [], [], []
        for q, code, unit in zip(query_ids.tolist(), query_codes, query_units, strict=True):
            found = index.retrieve(code, radius)
            # Summed row by row, so that a score is the same wherever its vector stands.
            score = (own[found] * unit).sum(axis=1)
            if len(found) > k:
                near = score >= np.partition(score, len(score) - k)[len(score) - k]
                found, score = found[near], score[near]
            best = np.lexsort((ids[found], -score))[:k]
            out_q += [q] * len(best)
            out_v += ids[found[best]].tolist()
            out_s += score[best].tolist()
        return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], names=["query", "vid", "score"])

    return search


def best(hits: DataFrame, by: str, k: int, vec_id: str = "vid") -> DataFrame:
    """The ``k`` rows of the largest score for each ``by``, with their rank."""
    rank = F.row_number().over(Wd.partitionBy(by).orderBy(F.col("score").desc(), vec_id))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def substrings(code: Column, bits: int, width: int) -> Column:
    """Array of struct(part, value): the substrings of a code of 64-bit words."""
    per = 64 // width
    value = lambda j: F.shiftrightunsigned(F.get(code, F.lit(j // per)), (j % per) * width).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*[F.struct(F.lit(j).alias("part"), value(j).alias("value")) for j in range(bits // width)])


def _probed(codes: DataFrame, queries: DataFrame, dim: int, bits: int, rows: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The nearest ``k`` found (query, vid, score, rank) for ``queries`` (vid) by joining the substring index; and the queries that are finished."""
    width = 16 if rows <= 1 << 20 else 32
    radius = (bits // width) * (WITHIN + 1) - 1
    index = codes.select("vid", F.inline(substrings(F.col("code"), bits, width)))
    asked = codes.join(queries, "vid", "left_semi")
    flips = F.array(*[F.lit(m).cast("long") for m in [0, *[1 << i for i in range(width)]]])
    probes = asked.select(F.col("vid").alias("query"), F.inline(substrings(F.col("code"), bits, width))).select("query", "part", "value", F.explode(flips).alias("flip"))
    probes = probes.select("query", "part", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    crowded = materialise(index.groupBy("part", "value").count().where(F.col("count") > BUCKET_ROWS).select("part", "value"), "crowded")
    met = materialise(probes.join(crowded, ["part", "value"], "left_semi").select("query").distinct(), "met")
    # No probe is left that meets a crowded bucket; the buckets' rows go too, so that no task gathers them.
    joined = probes.join(met, "query", "left_anti").join(index.join(crowded, ["part", "value"], "left_anti"), ["part", "value"])
    pairs = materialise(joined.select("query", "vid").distinct(), "probed")
    left = asked.select(F.col("vid").alias("query"), F.col("vector").alias("in_query"), F.col("code").alias("query_code"))
    apart = F.aggregate(F.zip_with("query_code", "code", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    both = pairs.join(left, "query").join(codes, "vid").where(apart <= radius)
    scored = both.select("query", "vid", "in_query", "vector").mapInArrow(_cosines(dim), "query long, vid long, score double")
    hits = materialise(best(scored, "query", k), "hits")
    share = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "score"))) / np.pi
    needed = bits * share + MARGIN * F.sqrt(bits * share * (1 - share))
    return hits, hits.where((F.col("rank") == k) & (needed <= radius)).select(F.col("query").alias("vid"))


def search(table: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for every vec_id that meets ``is_query`` (of column vec_id)."""
    spark = table.sparkSession
    rows = only_columns(table, vec_id, vector).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where("vec_id is not null")
    finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    commonest = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    if commonest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = commonest.dim
    rows = materialise(rows.where(F.size("vector") == dim).groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    distinct = materialise(rows.groupBy("vector").agg(F.min("vec_id").alias("vid")), "distinct")
    names = materialise(rows.join(distinct, "vector").select("vec_id", "vid"), "names")
    total = distinct.count()
    sample = distinct.where(drawn(F.col("vid"), SAMPLE_ROWS, total)).select("vector").toArrow().column("vector")
    fitted = [_matrix(c, dim) for c in sample.chunks if len(c)]
    coder = Coder(np.concatenate(fitted) if fitted else np.eye(dim), k)
    codes = distinct.select("vid", "vector").mapInArrow(_coder(ship(spark, coder), coder.bits // 64), "vid long, vector array<double>, code array<long>")
    codes = materialise(codes, "codes")
    asked = names.where(is_query).select("vec_id", "vid")
    queries = materialise(asked.select("vid").distinct(), "queries")
    # One more than k, since a query's own vector is among them.
    hits, finished = _probed(codes, queries, dim, coder.bits, total, k + 1)
    # Every block adds to one table, so that plans don't grow with the blocks.
    path = new_path(spark, "found")
    hits.join(finished.withColumnRenamed("vid", "query"), "query", "left_semi").select("query", "vid", "score").write.parquet(path)
    rest = materialise(codes.join(queries.join(finished, "vid", "left_anti"), "vid", "left_semi"), "rest")
    blocks = max(1, -(-rest.count() // _fitting(QUERY_BLOCK, dim)))
    for block in range(blocks):
        part = rest.where(F.pmod(F.xxhash64("vid", F.lit(1)), F.lit(blocks)) == block).toArrow()
        ids = np.array(part.column("vid"), dtype=np.int64)
        if not len(ids):
            continue
        vectors = np.concatenate([_matrix(c, dim) for c in part.column("vector").chunks])
        words, radius = coder.codes(vectors), coder.radius
        while len(ids):
            shipped = ship(spark, (ids, vectors, words))
            got = materialise(best(codes.mapInArrow(_searcher(shipped, radius, k + 1), "query long, vid long, score double"), "query", k + 1), "hits")
            shipped.destroy()
            short = np.zeros(len(ids), bool)
            if radius < coder.bits:
                full = got.where(F.col("rank") == min(k + 1, total)).select("query").toArrow().column("query")
                short = ~np.isin(ids, np.array(full, dtype=np.int64))
            if short.any():
                again = spark.createDataFrame(pa.table({"query": ids[short]}))
                got = got.join(F.broadcast(again), "query", "left_anti")
            got.select("query", "vid", "score").write.mode("append").parquet(path)
            ids, vectors, words, radius = ids[short], vectors[short], words[short], min(coder.bits, max(2 * radius, 16))
    found = spark.read.schema("query long, vid long, score double").parquet(path)
    owners = names.join(found.select("vid").distinct(), "vid", "left_semi")
    owners = owners.withColumn("rank", F.row_number().over(Wd.partitionBy("vid").orderBy("vec_id"))).where(F.col("rank") <= k + 1).select("vid", "vec_id")
    nearest = asked.toDF("query_id", "query").join(found, "query").join(owners, "vid").where("query_id <> vec_id")
    return best(nearest, "query_id", k, "vec_id").select("query_id", "rank", "vec_id", "score")
