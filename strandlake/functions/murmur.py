"""MurmurHash3 (x64, 128 bits; the first 64) of k-mers, for sketches exchanged with other tools."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.arrays import flat, slices
from strandlake.functions.alphabet import DNA
from strandlake.functions.hashing import rotl
from strandlake.kmers import PACKED_K, kmers, pack, pack_reverse, window_codes
from strandlake.tables import ship_package

#: Constants of the published algorithm; fixed values.
C1, C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
A1, A2 = np.uint64(0x52DCE729), np.uint64(0x38495AB5)
SEED = 42


def _mix(h: np.ndarray) -> np.ndarray:
    for m in (M1, M2):
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


def murmur64(rows: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Unsigned hashes of the rows of a byte matrix."""
    n, length = rows.shape
    with np.errstate(over="ignore"):
        h1, h2 = np.full(n, seed, np.uint64), np.full(n, seed, np.uint64)
        wide = np.zeros((n, -(-length // 16) * 16), np.uint8)
        wide[:, :length] = rows
        words = wide.view("<u8")
        for i in range(0, words.shape[1], 2):
            whole, rest = 8 * (i + 2) <= length, length - 8 * i
            h1 = h1 ^ rotl(words[:, i] * C1, 31) * C2
            if whole:
                h1 = (rotl(h1, 27) + h2) * np.uint64(5) + A1
            if whole or rest > 8:
                h2 = h2 ^ rotl(words[:, i + 1] * C2, 33) * C1
            if whole:
                h2 = (rotl(h2, 31) + h1) * np.uint64(5) + A2
        h1, h2 = h1 ^ np.uint64(length), h2 ^ np.uint64(length)
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _mix(h1), _mix(h2)
        return h1 + h2


#: K-mers whose texts are hashed at once.
_ROWS = 1 << 16
_SWAP = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"ACGT", b"TGCA", strict=True):
    _SWAP[_a] = _b


def murmur_kmers(reads: DataFrame, k: int, seed: int = SEED, keep: tuple[str, ...] = ("seq_no",)) -> DataFrame:
    """(*keep, pos, h) of every k-mer without an ambiguous symbol: the hash of the lesser of it and its reverse complement.

    Windows of whole batches are compared packed and hashed together; k-mers too
    long to be packed are cut and compared as texts.
    """
    ship_package(reads)
    if k > PACKED_K:
        return _long_murmur(reads, k, seed, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, at, piece, offset in slices(*flat(batch.column("sequence")), k - 1):
                codes, start, row = window_codes(data, at, k)
                if len(start) == 0:
                    continue
                turned = pack_reverse(codes, k) < pack(codes, k)
                texts, other = np.lib.stride_tricks.sliding_window_view(data, k), np.lib.stride_tricks.sliding_window_view(_SWAP[data[::-1]], k)[::-1]
                h = np.empty(len(start), np.uint64)
                for i in range(0, len(start), _ROWS):
                    own = start[i : i + _ROWS]
                    h[i : i + _ROWS] = murmur64(np.where(turned[own, None], other[own], texts[own]), seed)
                rows = pa.array(piece[row])
                place = pa.array((start - at[row] + offset[row]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in keep), place, pa.array(h.view(np.int64))], names=[*keep, "pos", "h"])

    kinds = dict(reads.dtypes)
    return reads.select(*keep, "sequence").mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keep) + "pos int, h long")


def _long_murmur(reads: DataFrame, k: int, seed: int, keep: tuple[str, ...]) -> DataFrame:
    rows = kmers(reads, k, keep).where(F.col("kmer").rlike("^[ACGT]*$"))
    rows = rows.select(*keep, "pos", F.least("kmer", DNA.reverse_complement(F.col("kmer"))).alias("kmer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data = np.frombuffer("".join(batch.column("kmer").to_pylist()).encode(), np.uint8)
                h = pa.array(murmur64(data.reshape(-1, k), seed).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keep, "pos")), h], names=[*keep, "pos", "h"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*keep, "pos")) + ", h long")
