"""Batch helpers over the UTF-8 bytes of an Arrow text column: slices, words, and hashes of spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # texts of about so many bytes are worked on at a time; bounds NumPy's temporaries
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=U64)
_powers = [np.ones(1, U64), np.ones(1, U64)]

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts together and the offsets of each; null is empty."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES):
    """Row slices of the batches with at most ``limit`` bytes of text, or one longer row: (rows, data, offsets)."""
    for batch in batches:
        data, off = utf8(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row), data[off[row]:off[end]], off[row:end + 1] - off[row]
            row = end


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers; a bijection."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; quicker than np.unique, which hashes them."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


class SpanHash:
    """64-bit hashes of any spans of ``data``, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers_to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[data] * power[:len(data)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` within each text: starts, ends, and the first run of each text (and of none after)."""
    n = len(inside)
    left = np.empty(n, bool)
    right = np.empty(n, bool)
    if n:
        left[0] = right[-1] = True
        np.logical_not(inside[:-1], out=left[1:])
        np.logical_not(inside[1:], out=right[:-1])
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        left[cuts] = True
        right[cuts - 1] = True
    start = np.flatnonzero(left & inside)
    end = np.flatnonzero(right & inside) + 1
    return start, end, np.searchsorted(start, off)


def words(data: np.ndarray, off: np.ndarray):
    """Runs of anything but ASCII white space, as ``spans``."""
    return spans(~WHITE[data], off)


def per_text(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``flag`` over each text's positions."""
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def windows_of(values: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive values within each text, and where each window starts."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = values[:n].copy()
    for k in range(1, width):
        out = mix(out * U64(0x2545F4914F6CDD1D)) + values[k:k + n]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[:n] == text[width - 1:width - 1 + n])
    return mix(out[at]), at
