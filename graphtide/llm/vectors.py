"""Vectors of Arrow list columns as matrices of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Lists:
    """A list column of numbers: all values as double in a row, and which lists are whole (not null, no null or non-finite entry)."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if pa.types.is_null(column.type):
            column = column.cast(pa.list_(pa.float64()))
        off = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.values.slice(off[0], off[-1] - off[0]) if len(off) else column.values
        self.off = off - off[0] if len(off) else np.zeros(1, np.int64)
        self.values = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        self.lengths = np.diff(self.off)
        self.whole = self.all_in(np.isfinite(self.values)) & column.is_valid().to_numpy(zero_copy_only=False)

    def all_in(self, good: np.ndarray) -> np.ndarray:
        """Which lists hold good values only."""
        bad = np.concatenate([[0], np.cumsum(~good)])
        return bad[self.off[1:]] == bad[self.off[:-1]]

    def floors(self, scale: int, most: float) -> np.ndarray:
        """floor(scale * value) of all values as long; lists with one beyond most in size are not whole any more."""
        x = np.floor(self.values * scale)
        fits = np.abs(x) <= most  # false for nan as well
        self.whole &= self.all_in(fits)
        return np.where(fits, x, 0).astype(np.int64)

    def matrix(self, x: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
        """The values x of some rows, one line each of width entries; shorter lists end in zeros, longer ones are cut."""
        if not len(x) or not width:
            return np.zeros((len(rows), width), x.dtype)
        at = self.off[rows][:, None] + np.arange(width)
        inside = np.arange(width) < self.lengths[rows][:, None]
        return np.where(inside, x[np.minimum(at, len(x) - 1)], 0)
