"""Vectorised text kernels over Arrow string buffers.

A batch is cut into chunks of about CHUNK_BYTES of text (one longer document makes a chunk of its
own), so that memory follows the longest document and never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 17
_U = np.uint64
_RNG = np.random.default_rng(20240607)
#: One random 64-bit value for each byte value; the same in every process.
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 65536)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), bijective."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def is_space(b: np.ndarray) -> np.ndarray:
    """0x20 and 0x09 to 0x0D."""
    return (b == 32) | ((b - np.uint8(9)) <= 4)


def ascii_lower(b: np.ndarray) -> np.ndarray:
    return b + (((b - np.uint8(65)) <= 25).astype(np.uint8) << np.uint8(5))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and row of each maximal run of inside bytes that stays in one row."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0] - 1
    last[cuts] = inside[cuts]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def span_codes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code of the bytes of each span, the same wherever the span stands."""
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE_CODE[b] * powers(_BASE, len(b)), out=total[1:])
    return mix((total[end] - total[start]) * powers(_INVERSE, len(b) + 1)[start] + (end - start).astype(np.uint64))


def words_of(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and code of each word [^\\x20\\x09-\\x0D]+."""
    start, end, row = spans(~is_space(b), offsets)
    return start, end, row, span_codes(b, start, end)


def row_bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Where the items of row r stand: bounds[r] to bounds[r + 1] (row is ascending)."""
    return np.searchsorted(row, np.arange(rows + 1))
