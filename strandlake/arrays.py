"""Flat NumPy views of Arrow text columns, for kernels over whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Symbols that a kernel takes at once; longer texts are cut with an overlap.
SLICE = 1 << 20


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, row offsets into them); null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``arange(s, s + n)`` of all pairs, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def slices(data: np.ndarray, at: np.ndarray, overlap: int, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row of each piece, its place in the row) of pieces of at most ``most`` bytes a time.

    Rows that are longer are cut into pieces that share ``overlap`` bytes.
    """
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        lo, hi = int(at[first]), int(at[last])
        if hi - lo <= most or last > first + 1:
            yield data[lo:hi], at[first : last + 1] - lo, np.arange(first, last), np.zeros(last - first, np.int64)
        else:
            for begin in range(lo, max(hi - overlap, lo + 1), most):
                own = data[begin : min(begin + most + overlap, hi)]
                yield own, np.array([0, len(own)]), np.array([first]), np.array([begin - lo])
        first = last


def window_starts(at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of every k-symbol window that lies in one row, its row)."""
    n = np.maximum(np.diff(at) - k + 1, 0)
    return ranges(at[:-1], n), np.repeat(np.arange(len(n)), n)
