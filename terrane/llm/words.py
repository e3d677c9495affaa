"""Vectorised tokenising of Arrow string columns: 64-bit word fingerprints straight from the UTF-8 bytes.

A word's fingerprint is a polynomial hash of its bytes modulo 2**64 over random byte values, finished by a mixer.
``A-Z`` count as ``a-z``; all other characters are as they stand. Two word classes are offered: ``ALNUM`` is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text, ``SPACED`` is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))


def _byte_values() -> np.ndarray:
    values = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    values[65:91] = values[97:123]
    return values


def _alnum() -> np.ndarray:
    inside = np.zeros(256, bool)
    inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    return inside


def _spaced() -> np.ndarray:
    inside = np.ones(256, bool)
    inside[[32, 9, 10, 11, 12, 13]] = False
    return inside


ALNUM, SPACED = "alnum", "spaced"
_CLASSES = {ALNUM: _alnum(), SPACED: _spaced()}
_VALUES = _byte_values()
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row's start (one more than rows). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def spans(data: np.ndarray, at: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; no word reaches over a row's edge."""
    inside = _CLASSES[kind][data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = at[(at > 0) & (at < len(data))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def fingerprints(column: pa.Array | pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of all words of a column in order, and where each row's words start (one more than rows)."""
    data, at = utf8(column)
    begins, ends = spans(data, at, kind)
    out = np.empty(len(begins), np.uint64)
    i = 0
    while i < len(begins):
        lo = begins[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + SEGMENT, "right")))
        hi = ends[j - 1]
        up, down = _power_table(int(hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_VALUES[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        b, e = begins[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[b]) * down[b]
        i = j
    return mix(out), np.searchsorted(begins, at)


def pieces(batches, column: int | str, most: int = 4 << 20):
    """The batches in slices of about ``most`` bytes of text, so that memory doesn't follow the batch size."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def of_texts(texts: list[str | None], kind: str) -> list[np.ndarray]:
    """Word fingerprints of each text."""
    words, at = fingerprints(pa.array(texts, pa.string()), kind)
    return [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
