"""Toxicity scores from class-conditional Kneser-Ney models.

An expression is a word (A-Z folded, all its characters); of an unspaced run, every ``UNIT`` characters of it. It is
generated character by character, its end included. The context of a character is the whole beginning of the
expression before it, and from ``ORDER`` characters on the last ``ORDER - 1``. For each class (toxic, ordinary) the
estimate is of the Kneser-Ney kind with absolute discounting,

    P_c(x | context) = (1 - w(context)) m_c(context x) / m_c(context) + w(context) P(x | context),

where m_c is the class's count less a discount D (summed over the characters that follow, for the context), w is the
share of the count that discounting both classes together sets free, and the backoff P counts in how many distinct
expressions of either class the character continues the context. Backoff weights and backoff counts are shared by the
classes, so that rare expressions and unseen inflections of a stem get the evidence of the part that is known. (With
weights of their own, the smaller class would favour everything rare.) A character that no expression has in its
context takes both classes' backoff weights and is looked up behind the ``SHORT - 1`` characters before it, likewise.

An expression's evidence is the difference of its toxic and ordinary log likelihoods. A text is compared by its
length-normalised likelihoods, the mean difference per expression, and by those of its most toxic places (the first,
second and third of ``TOP``), turned into a probability by a logistic curve. The curve is fitted on a bounded sample
(``CALIBRATION_ROWS``) of a quarter of the training rows, seen through a model of the other three quarters.

Scale: expressions are counted over all labelled training rows, one row per distinct expression and piece of text.
Contexts and steps are joins and partial aggregates over the table of distinct expressions, however rare. The model is
a table of 12 bytes per step, cut into shards of about ``SHARD_ROWS``: the driver fetches and ships one at a time, and a
task holds one at a time, asked for the distinct expressions of a piece of text that grows with the number of shards.
Executors keep the shards they don't need on disk. Scoring is one pass over the texts without a shuffle.

Defined cases: a null or wordless text scores the curve's value without evidence; very long texts are read whole;
labels that are null don't count; of contradicting labels the toxic one counts; without labelled rows of both classes
every score is 0; repeated rows each get their row, equal texts the same score; rows without doc_id are scored but
never trained on; an empty table has no rows; extra columns are ignored by ``report`` and stay in ``score``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import drawn, fresh, materialise, only_columns, opened, small

ORDER = 8
SHORT = 4
UNIT = 16
DISCOUNT = 0.75
TOP = (1, 2, 3)
ASIDE = 4
SHARD_ROWS = 4_000_000
FETCH_ROWS = 500_000
AT_ONCE = 1 << 14
PIECE = 2 << 20
CALIBRATION_ROWS = 20_000
BROADCAST_ROWS = 2_000_000
THRESHOLD = 0.3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FACTORS = np.random.default_rng(23).integers(0, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MARKS = np.random.default_rng(24).integers(0, 1 << 63, (2, ORDER + 2), dtype=np.uint64)


def expressions(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Expressions of a column, which of them stands at each place, and where each row's places start."""
    prints, at = W.fingerprints(column, W.ALNUM)
    if not len(prints):
        return [], np.zeros(0, np.int64), at
    data, rows = W.utf8(column)
    begins, ends = W.spans(data, rows, W.ALNUM)
    _, first, back = np.unique(prints, return_index=True, return_inverse=True)
    raw = _FOLD[data].tobytes()
    found = [raw[b:e].decode(errors="replace") for b, e in zip(begins[first].tolist(), ends[first].tolist(), strict=True)]
    parts = np.array([-(-len(w) // UNIT) for w in found])
    if parts.max() == 1:
        return found, back, at
    units = [w[i : i + UNIT] for w in found for i in range(0, len(w), UNIT)]
    starts, n = np.cumsum(parts) - parts, parts[back]
    ahead = np.concatenate([[0], np.cumsum(n)])
    places = np.repeat(starts[back] - ahead[:-1], n) + np.arange(ahead[-1])
    return units, places, ahead[at]


def steps(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of every character's step in its long and short context, and where each unit's characters start.

    Four rows of keys: long gram, long context, short gram, short context; 0 where the short context isn't whole.
    """
    n = np.array([len(u) + 1 for u in units])
    starts = np.cumsum(n) - n
    x = np.frombuffer("".join(u + "\0" for u in units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    depth = np.arange(len(x)) - np.repeat(starts, n)
    context = np.zeros(len(x), np.uint64)
    for k in range(1, ORDER):
        context[k:] += np.where(depth[k:] >= k, x[:-k] * _FACTORS[k], np.uint64(0))
        if k == SHORT - 1:
            short = context.copy()
    place = np.minimum(depth, ORDER)
    whole = depth >= SHORT - 1
    gram = lambda c, mark: W.mix(c + x * _FACTORS[0] + mark)
    keys = np.stack([gram(context, _MARKS[0][place]), W.mix(context + _MARKS[1][place]), np.where(whole, gram(short, _MARKS[0][ORDER + 1]), 0), np.where(whole, W.mix(short + _MARKS[1][ORDER + 1]), 0)])
    return keys, starts, n


Look = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def evidence(units: list[str], look: Look, at_once: int = AT_ONCE) -> np.ndarray:
    """The log likelihood ratio of each unit. ``look``: the values of keys (0 if unknown), and which are known."""
    return np.concatenate([np.zeros(0), *[_evidence(units[i : i + at_once], look) for i in range(0, len(units), at_once)]])


def _evidence(units: list[str], look: Look) -> np.ndarray:
    keys, starts, _ = steps(units)
    value, known = look(keys[0])
    missed = np.flatnonzero(~known)
    asked = keys[1:, missed]
    got, there = look(asked.ravel())
    left, short, short_left = got.reshape(asked.shape)
    value[missed] = left + np.where(there.reshape(asked.shape)[1], short, short_left)
    return np.add.reduceat(value, starts)


def features(look: Look, column: pa.Array, at_once: int = AT_ONCE) -> np.ndarray:
    """Per row: the evidence of its most toxic places, each of ``TOP`` (the last one, if there are fewer), and the mean."""
    units, places, at = expressions(column)
    out = np.zeros((len(at) - 1, len(TOP) + 1))
    if not units:
        return out
    each = evidence(units, look, at_once)[places]
    n = np.diff(at)
    rows = np.flatnonzero(n)
    out[rows, -1] = np.add.reduceat(each, at[:-1][rows]) / n[rows]
    ranked = each[np.lexsort((-each, np.repeat(np.arange(len(n)), n)))]
    for i, k in enumerate(TOP):
        out[rows, i] = ranked[at[:-1][rows] + np.minimum(k, n[rows]) - 1]
    return out


def _arrays(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A shard's keys and values, in place."""
    n = len(data) // 12
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float32, n, 8 * n)


class Store:
    """A model's shards, shipped one by one; looks keys up with one of them in memory."""

    def __init__(self, table: DataFrame, shard_rows: int) -> None:
        """``table``: key, value."""
        self.shards = []
        self.n = max(1, -(-table.count() // shard_rows))
        parts = max(1, -(-shard_rows // FETCH_ROWS)) if self.n > 1 else max(1, -(-table.count() // FETCH_ROWS))
        for i in range(self.n):
            # A shard comes in parts, so that the JVM doesn't hold it as a whole.
            keys, values = [], []
            for j in range(parts):
                part = table.where(F.pmod("key", F.lit(self.n * parts)) == i + j * self.n).toArrow()
                keys.append(np.array(part.column("key"), dtype=np.int64))
                values.append(np.array(part.column("value"), dtype=np.float32))
            keys, values = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(keys)
            self.shards.append(table.sparkSession.sparkContext.broadcast(keys[order].tobytes() + values[order].tobytes()))

    def look(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # In order, so that neighbouring searches read the same memory.
        asked, back = np.unique(asked.view(np.int64), return_inverse=True)
        value, known = np.zeros(len(asked)), np.zeros(len(asked), bool)
        for i, shard in enumerate(self.shards):
            mine = np.arange(len(asked)) if self.n == 1 else np.flatnonzero(asked % self.n == i)
            with opened(shard, self.n == 1, _arrays) as (keys, values):
                if len(keys) and len(mine):
                    where = np.minimum(np.searchsorted(keys, asked[mine]), len(keys) - 1)
                    hit = keys[where] == asked[mine]
                    value[mine[hit]], known[mine[hit]] = values[where[hit]], True
        return value[back], known[back]

    @property
    def pieces(self) -> int:
        """How many times the usual to take at once, of bytes and of units: the more shards, the more, up to a bound."""
        return min(self.n, 16)

    def release(self) -> None:
        for shard in self.shards:
            shard.destroy()


COUNTS = ["toxic", "ordinary", "toxic_aside", "ordinary_aside"]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.pieces(batches, 0):
        units, places, at = expressions(batch.column(0))
        toxic, aside = (np.repeat(np.array(batch.column(i), dtype=np.int64), np.diff(at)) for i in (1, 2))
        sums = [np.bincount(places, w, minlength=len(units)).astype(np.int64) for w in (toxic, 1 - toxic, toxic * aside, (1 - toxic) * aside)]
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), *map(pa.array, sums)], names=["unit", *COUNTS])


def _stepper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["gram", "context", "toxic", "ordinary", "kinds"]
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, _, n = steps(batch.column(0).to_pylist())
        counts = [np.repeat(np.array(batch.column(i), dtype=np.int64), n) for i in (1, 2)]
        for gram, context in (keys[:2], keys[2:]):
            there = gram != 0
            distinct, first, back = np.unique(gram[there], return_index=True, return_inverse=True)
            sums = [np.bincount(back, c[there], minlength=len(distinct)).astype(np.int64) for c in counts]
            columns = [distinct.view(np.int64), context[there][first].view(np.int64), *sums, np.bincount(back, minlength=len(distinct))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def model_table(counted: DataFrame) -> DataFrame:
    """``(key, value)`` of every step and of leaving every context; ``counted``: unit, toxic, ordinary."""
    grams = counted.where("toxic + ordinary > 0").mapInArrow(_stepper, "gram long, context long, toxic long, ordinary long, kinds long")
    grams = materialise(grams.groupBy("gram").agg(F.first("context").alias("context"), *[F.sum(c).alias(c) for c in ("toxic", "ordinary", "kinds")]), "grams")
    mass = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))
    both = F.col("toxic") + F.col("ordinary")
    contexts = grams.groupBy("context").agg(F.sum(mass("toxic")).alias("toxic_all"), F.sum(mass("ordinary")).alias("ordinary_all"), (F.sum(F.least(both, F.lit(DISCOUNT))) / F.sum(both)).alias("free"), F.sum("kinds").alias("kinds_all"))
    contexts = materialise(contexts, "contexts")
    shared = F.col("kinds") / F.col("kinds_all")
    log_p = lambda c: F.log(F.when(F.col(f"{c}_all") > 0, (1 - F.col("free")) * mass(c) / F.col(f"{c}_all") + F.col("free") * shared).otherwise(shared))
    step = grams.join(contexts, "context").select(F.col("gram").alias("key"), (log_p("toxic") - log_p("ordinary")).cast("float").alias("value"))
    weight = lambda c: F.when(F.col(f"{c}_all") > 0, F.log("free")).otherwise(F.lit(0.0))
    leave = contexts.select(F.col("context").alias("key"), (weight("toxic") - weight("ordinary")).cast("float").alias("value")).where("value <> 0")
    return step.unionAll(leave)


def _measure(store: Store):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, 0, PIECE * store.pieces):
            f = features(store.look, batch.column(0), AT_ONCE * store.pieces)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1]), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], names=["toxic", "features"])

    return measure


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a slightly damped logistic regression, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    damp = np.full(x.shape[1], 1e-2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(damp), x.T @ (y - p) - damp * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def is_aside(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(ASIDE)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    marks = only_columns(labels, doc_id, label).toDF("doc_id", "toxic").where("doc_id is not null and toxic is not null")
    marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    rows = only_columns(docs, doc_id, text).toDF("doc_id", "text").where(F.col("text").isNotNull())
    return rows.join(F.broadcast(marks) if small(marks, BROADCAST_ROWS) else marks, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[Store, np.ndarray] | None:
    """The model and the curve's weights; None without training rows of both classes."""
    train = training_rows(docs, labels, doc_id, text, label).withColumn("aside", F.when(is_aside(F.col("doc_id")), 1).otherwise(0))
    counts = train.select("text", "toxic", "aside").mapInArrow(_counter, "unit string, " + ", ".join(f"{c} long" for c in COUNTS))
    counts = materialise(counts.groupBy("unit").agg(*[F.sum(c).alias(c) for c in COUNTS]), "counts")
    toxic, ordinary, toxic_aside, ordinary_aside = (n or 0 for n in counts.agg(*[F.sum(c) for c in COUNTS]).first())
    if not toxic or not ordinary:
        return None
    store = Store(materialise(model_table(counts.select("unit", "toxic", "ordinary")), "model"), SHARD_ROWS)
    judge, judged = store, train
    if 0 < toxic_aside < toxic and 0 < ordinary_aside < ordinary:
        rest = counts.select("unit", (F.col("toxic") - F.col("toxic_aside")).alias("toxic"), (F.col("ordinary") - F.col("ordinary_aside")).alias("ordinary"))
        judge, judged = Store(materialise(model_table(rest), "model"), SHARD_ROWS), train.where("aside = 1")
    part = judged.where(drawn(F.col("doc_id"), CALIBRATION_ROWS, judged.count()))
    got = part.select("text", "toxic").mapInArrow(_measure(judge), "toxic long, features array<double>").toArrow()
    if judge is not store:
        judge.release()
    x = np.concatenate([np.array(c.flatten()) for c in got.column("features").chunks]).reshape(-1, len(TOP) + 1)
    return store, _logistic(x, np.array(got.column("toxic"), dtype=float))


def _scorer(fitted: tuple[Store, np.ndarray] | None, n_keep: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, 0, PIECE * (fitted[0].pieces if fitted else 1)):
            if fitted is None:
                scores = np.zeros(batch.num_rows)
            else:
                store, w = fitted
                scores = 1 / (1 + np.exp(-np.clip(w[0] + features(store.look, batch.column(0), AT_ONCE * store.pieces) @ w[1:], -500, 500)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(1, 1 + n_keep)], pa.array(scores)], names=[*batch.schema.names[1:], "score"])

    return score


def score(docs: DataFrame, fitted: tuple[Store, np.ndarray] | None, text: str = "text") -> DataFrame:
    """``docs`` with score, the probability of being toxic, instead of a column of that name."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "score"]
    schema = docs.select(*kept).withColumn("score", F.lit(0.0)).schema
    return docs.select(F.col(f"`{text}`").alias(fresh(docs, "text")[0]), *kept).mapInArrow(_scorer(fitted, len(kept)), schema)


def report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score of 0.3 or more)."""
    fitted = fit(docs, labels, doc_id, text, label)
    scored = score(only_columns(docs, doc_id, text), fitted, text)
    return scored.select(doc_id, held_out(F.col(doc_id)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
