"""Elias-Fano coding of ascending integers, with select.

n values below u take about 2 + log2(u/n) bits each: the low bits stand packed,
the high parts are unary gaps in a bit array.  A directory of 32-bit positions,
one for every 512th value, starts a select near its place.
"""

from __future__ import annotations

import struct

import numpy as np

_SAMPLE = 512


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """From non-negative ascending values (repeats allowed)."""
        v = np.asarray(values, np.uint64)
        n = len(v)
        if n and (v[1:] < v[:-1]).any():
            raise ValueError("values must ascend")
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            bits = ((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits.reshape(-1), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        place = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = int(place[-1]) + 1 if n else 0
        if size >= 1 << 32:
            raise ValueError("too many values for one shard")
        unary = np.zeros(size, np.uint8)
        unary[place] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), place[::_SAMPLE].astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            out |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def select(self, i: np.ndarray) -> np.ndarray:
        """Values at the given ranks, each from its directory entry on."""
        i = np.asarray(i, np.int64)
        if len(i) and (i.min() < 0 or i.max() >= self.n):
            raise IndexError("rank out of range")
        place = np.zeros(len(i), np.int64)
        block = i // _SAMPLE
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        for rows in np.split(order, cuts) if len(i) else []:
            b = int(block[rows[0]])
            first = int(self.samples[b])
            last = int(self.samples[b + 1]) if b + 1 < len(self.samples) else len(self.high) * 8
            ones = np.flatnonzero(np.unpackbits(self.high[first >> 3 : (last + 7 >> 3) + 1], bitorder="little"))
            ones = ones[np.searchsorted(ones, first & 7) :]
            place[rows] = ones[i[rows] - b * _SAMPLE] + (first >> 3 << 3)
        return ((place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QIQQI", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The structure at the start of ``data``, and its size."""
        form = "<QIQQI"
        n, low_bits, low, high, samples = struct.unpack_from(form, data)
        at = struct.calcsize(form)
        arrays = []
        for size, kind in ((low, np.uint8), (high, np.uint8), (samples, np.uint32)):
            wide = size * np.dtype(kind).itemsize
            arrays.append(np.frombuffer(data[at : at + wide], kind))
            at += wide
        return cls(n, low_bits, *arrays), at
