"""Benchmark decontamination with a generalised suffix automaton over the normalised test items.

The automaton holds every substring (in words) of every item. A document's words are streamed through it; after each
word the automaton knows the longest suffix read so far that stands in some item. Where that length reaches the
window (13 words by default) the last ``window`` words are a hit; items shorter than the window count as one window
of their own. The state reached also names the items that hold the window.

Most stretches of a document can't reach a window: a run of words is only streamed if each of its word pairs stands in
some item, which is one vectorised look-up for a whole Arrow batch. Words are compared by 64-bit fingerprint.

Scale: documents are scanned once, without a shuffle. The automaton's size follows the benchmark, whose words are
counted first; a benchmark above ``shard_words`` is cut into shards with one automaton each. A task tokenises a piece of
text once and asks one shard after the other, holding one at a time; the more shards, the larger the piece.

Defined cases: a null or empty text has no words and is clean; a null or wordless item has no windows; a null item_id
is left out of ``items`` names but its windows still count as hits; rows with the same item_id are one item; an empty
benchmark hits nothing; coverage at the limit exactly counts; very long texts are read whole; repeated document rows each
get their row; an empty table has no rows; extra columns are ignored by ``report`` and stay in ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import fresh, only_columns, opened, ship

WINDOW = 13
MIN_COVERAGE = 0.05
SHARD_WORDS = 250_000


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word ids, with the windows' items on its states."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.items: dict[int, set[int]] = {}

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            if (q := self.next[last].get(word)) is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = new

    def read(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and the length of the longest suffix that stands in some item."""
        state, length = 0, 0
        for word in sequence:
            while (to := self.next[state].get(word)) is None and state:
                state = self.link[state]
                length = self.length[state]
            state, length = (0, 0) if to is None else (to, length + 1)
            yield state, length

    def holding(self, state: int, length: int) -> int:
        """The state of the last ``length`` words, on the way from ``state`` to the root."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def mark(self, sequence: list[int], item: int, window: int) -> None:
        """Note ``item`` on the states of its windows."""
        if len(sequence) < window:
            state = 0
            for state, _ in self.read(sequence):
                pass
            self.short.setdefault(self.holding(state, len(sequence)), []).append((len(sequence), item))
            return
        for state, length in self.read(sequence):
            if length >= window:
                self.items.setdefault(self.holding(state, window), set()).add(item)

    def link_shorts(self) -> None:
        """Give each state the nearest state towards the root, itself included, that ends a short item."""
        self.ending = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.ending[state] = state if state in self.short else self.ending[self.link[state]]

    def hits(self, sequence: list[int], window: int) -> Iterator[tuple[int, int, set[int]]]:
        """First word, end and items of every window's occurrence in ``sequence``."""
        for i, (state, length) in enumerate(self.read(sequence)):
            if length >= window:
                yield i + 1 - window, i + 1, self.items[self.holding(state, window)]
            at = self.ending[state] if self.short else -1
            while at > 0:
                for n, item in self.short[at]:
                    if n <= length:
                        yield i + 1 - n, i + 1, {item}
                at = self.ending[self.link[at]]


def build(items: list[tuple[int | None, str | None]], window: int) -> tuple | None:
    """The automaton of some items, with what the vectorised look-up needs; None if they hold no word."""
    by_name: dict[str | None, int] = {}
    sequences = [(by_name.setdefault(None if name is None else str(name), len(by_name)), words) for (name, _), words in zip(items, W.of_texts([text for _, text in items], W.ALNUM), strict=True) if len(words)]
    if not sequences:
        return None
    vocabulary = np.unique(np.concatenate([words for _, words in sequences]))
    automaton = SuffixAutomaton()
    ids = [(item, np.searchsorted(vocabulary, words) + 1) for item, words in sequences]
    for _, seq in ids:
        automaton.add(seq.tolist())
    for item, seq in ids:
        automaton.mark(seq.tolist(), item, window)
    automaton.link_shorts()
    pairs = np.unique(np.concatenate([pair_codes(seq) for _, seq in ids]))
    shortest = min(min(len(seq), window) for _, seq in ids)
    return automaton, vocabulary, pairs, shortest, list(by_name)


def pair_codes(ids: np.ndarray) -> np.ndarray:
    ids = ids.astype(np.uint64)
    return (ids[:-1] << np.uint64(32)) | ids[1:]


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def stretches(words: np.ndarray, at: np.ndarray, vocabulary: np.ndarray, pairs: np.ndarray, shortest: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row, first word in the row and word ids of each run in which every adjacent pair stands in some item."""
    where = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    ids = np.where(vocabulary[where] == words, where + 1, 0)
    row_starts = at[1:-1]
    if shortest > 1:
        good = np.zeros(len(ids) + 1, bool)
        good[1:-1] = member(pair_codes(ids), pairs)
        good[row_starts] = False
        edges = np.flatnonzero(np.diff(good.astype(np.int8)))
        begins, ends = edges[::2], edges[1::2] + 1
    else:
        known = np.concatenate([[False], ids > 0, [False]])
        edges = np.flatnonzero(np.diff(known.astype(np.int8)))
        begins, ends = edges[::2], edges[1::2]
    keep = ends - begins >= shortest
    for b, e in zip(begins[keep].tolist(), ends[keep].tolist(), strict=True):
        cuts = [b, *row_starts[(row_starts > b) & (row_starts < e)].tolist(), e] if shortest == 1 else [b, e]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            row = int(np.searchsorted(at, lo, "right")) - 1
            yield row, lo - int(at[row]), ids[lo:hi]


def _merge(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(intervals):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


_HITS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
MADE = ("n_words", "hits", "items")


def _scanner(shards: list, text: str, window: int, made_names: tuple[str, str, str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_words_name, hits_name, items_name = made_names
        for batch in W.pieces(batches, text, (4 << 20) * min(max(1, len(shards)), 16)):
            words, at = W.fingerprints(batch.column(text), W.ALNUM)
            hits: list[list] = [[] for _ in range(batch.num_rows)]
            items: list[set] = [set() for _ in range(batch.num_rows)]
            for shard in shards if len(words) else []:
                with opened(shard, keep=len(shards) == 1) as (automaton, vocabulary, pairs, shortest, names):
                    for row, first, ids in stretches(words, at, vocabulary, pairs, shortest):
                        for b, e, which in automaton.hits(ids.tolist(), window):
                            if hits[row] and hits[row][-1][0] <= first + b <= hits[row][-1][1]:
                                hits[row][-1] = (hits[row][-1][0], max(hits[row][-1][1], first + e))
                            else:
                                hits[row].append((first + b, first + e))
                            items[row].update(names[i] for i in which if names[i] is not None)
            merged = [[{"begin": b, "end": e} for b, e in _merge(row)] for row in hits]
            made = {n_words_name: pa.array(np.diff(at)), hits_name: pa.array(merged, _HITS), items_name: pa.array([sorted(s) for s in items], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return scan


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, names: tuple[str, str, str] = MADE) -> DataFrame:
    """``docs`` with n_words, hits (merged word spans ``[begin, end)``) and items (names of items with occurring windows)."""
    spark = docs.sparkSession
    items = only_columns(benchmark, item_id, item_text).toDF("item_id", "item_text")
    # A word takes at least two characters with its separator, so this bounds the words without tokenising.
    n_shards = 1 + (items.agg(F.sum(F.length("item_text"))).first()[0] or 0) // (2 * shard_words)
    out = docs.withColumns(dict(zip(names, (F.lit(None).cast("long"), F.lit(None).cast("array<struct<begin:long,end:long>>"), F.lit(None).cast("array<string>")), strict=True)))
    shards = []
    for shard in range(n_shards):
        part = items if n_shards == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_shards)) == shard)
        model = build([tuple(r) for r in part.collect()], window)
        if model is not None:
            shards.append(ship(spark, model))
    return out.mapInArrow(_scanner(shards, text, window, names), out.schema)


def n_hit(hits: str = "hits") -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["begin"])


def contaminated(n_hit: Column, n_words: Column, min_coverage: float = MIN_COVERAGE) -> Column:
    """Whether hit words are at least ``min_coverage`` of all, in whole numbers; 0.05 is the same as 20 * n_hit >= n_words."""
    share = Fraction(str(min_coverage))
    return (n_hit > 0) & (n_hit * F.lit(share.denominator) >= n_words * F.lit(share.numerator))


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **more) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit spans."""
    scanned = scan(only_columns(docs, doc_id, text), benchmark, text, window=window, **more)
    return scanned.select(
        doc_id,
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        contaminated(n_hit(), F.col("n_words")).alias("contaminated"),
        "hits",
    )


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_coverage: float = MIN_COVERAGE, **more) -> DataFrame:
    """The documents that aren't contaminated, with their columns as they were."""
    n_words, hits, items = names = tuple(fresh(docs, *MADE))
    scanned = scan(docs, benchmark, text, names=names, **more)
    return scanned.where(~contaminated(n_hit(hits), F.col(n_words), min_coverage)).drop(*names)


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_words: int = WINDOW, min_coverage: float = MIN_COVERAGE, **more) -> DataFrame:
    """Documents below the coverage limit, without the hit spans of ``min_words`` words or more; heavier ones go."""
    n_words, hits, items = names = tuple(fresh(docs, *MADE))
    scanned = scan(docs, benchmark, text, names=names, **more)
    kept = scanned.where(~contaminated(n_hit(hits), F.col(n_words), min_coverage))
    long = F.filter(hits, lambda h: h["end"] - h["begin"] >= min_words)
    return kept.withColumn(text, F.when(F.size(long) > 0, F.pandas_udf(_cut_all, "string")(F.col(f"`{text}`"), F.when(F.size(long) > 0, long))).otherwise(F.col(f"`{text}`"))).drop(*names)


def _cut_all(texts: pd.Series, hits: pd.Series) -> pd.Series:
    return pd.Series([t if h is None else _cut(t, h) for t, h in zip(texts, hits, strict=True)], dtype=object)


def _cut(text: str, hits: list) -> str:
    data = text.encode()
    begins, ends = W.spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]), W.ALNUM)
    parts, at = [], 0
    for h in hits:
        parts.append(data[at : begins[h["begin"]]])
        at = ends[h["end"] - 1]
    return b"".join([*parts, data[at:]]).decode()


_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH item AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM item)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
pos AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, p.n, p.i, item_id FROM pos p JOIN win USING (n, s)),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, n, i FROM hit)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
