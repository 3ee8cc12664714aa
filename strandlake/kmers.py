"""K-mers of sequences: as text, or packed into longs of two bits a symbol (k up to 31).

Packed k-mers order as their texts do and take 8 bytes in shuffles, so queries
use them; texts come back at the end, of distinct k-mers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.arrays import flat, slices, window_starts
from strandlake.tables import ship_package

#: Start positions that are exploded from one piece; a long sequence is cut first,
#: as finding a place in a long string takes time in proportion to the place.
PIECE = 256
#: Longest k-mer that a long holds.
PACKED_K = 31
SYMBOLS = "ACGT"

_CODES = np.full(256, 4, np.uint8)
for _i, _s in enumerate(SYMBOLS):
    _CODES[ord(_s)] = _i


def pieces(sequence: Column, k: int, piece: int = PIECE) -> Column:
    """Array of (offset, piece) with k-1 characters of overlap, covering every k-mer once."""
    last = F.length(sequence) - k
    starts = F.sequence(F.lit(0), F.expr("0") + last, F.lit(piece))
    cut = F.transform(starts, lambda o: F.struct(o.alias("offset"), F.substr(sequence, o + 1, F.lit(piece + k - 1)).alias("piece")))
    return F.when(last >= 0, cut).otherwise(F.array().cast("array<struct<offset:int,piece:string>>"))


def kmers(reads: DataFrame, k: int, keep: tuple[str, ...] = ("seq_no",)) -> DataFrame:
    """(*keep, pos, kmer) of every k-mer as text; pos counts from 0; sequences shorter than k have none."""
    cut = reads.select(*keep, F.explode(pieces(F.col("sequence"), k)).alias("p"))
    cut = cut.select(*keep, "p.offset", "p.piece")
    places = F.sequence(F.lit(0), F.length("piece") - k)
    rows = cut.select(*keep, "offset", "piece", F.explode(places).alias("i"))
    return rows.select(*keep, (F.col("offset") + F.col("i")).alias("pos"), F.substr(F.col("piece"), F.col("i") + 1, F.lit(k)).alias("kmer"))


def pack(codes: np.ndarray, k: int) -> np.ndarray:
    """Every k-symbol window of an array of codes 0..3, as int64; windows are doubled, so it takes log2(k) steps."""
    n = len(codes) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    power, width, out, used = codes.astype(np.int64), 1, None, 0
    while True:
        if k & width:
            own = power[used : used + n]
            out = own.copy() if out is None else (out << (2 * width)) | own
            used += width
        if 2 * width > k:
            return out
        power = (power[:-width] << (2 * width)) | power[width:]
        width *= 2


def pack_reverse(codes: np.ndarray, k: int) -> np.ndarray:
    """The reverse complement of every window."""
    return pack(3 - codes[::-1], k)[::-1]


def window_codes(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts of windows of ACGT alone, their rows)."""
    codes = _CODES[data]
    start, row = window_starts(at, k)
    bad = codes > 3
    if bad.any():
        sums = np.concatenate(([0], np.cumsum(bad)))
        ok = sums[start + k] == sums[start]
        start, row = start[ok], row[ok]
        codes = np.where(bad, 0, codes).astype(np.uint8)
    return codes, start, row


def packed_kmers(reads: DataFrame, k: int, keep: tuple[str, ...] = ("seq_no",), canonical: bool = False) -> DataFrame:
    """(*keep, pos, kmer) of every k-mer of ACGT, packed; with ``canonical`` the lesser of it and its reverse complement.

    A k-mer with another symbol is left out; null and short sequences have none.
    """
    if not 1 <= k <= PACKED_K:
        raise ValueError(f"k must be from 1 to {PACKED_K}")
    ship_package(reads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, at, piece, offset in slices(*flat(batch.column("sequence")), k - 1):
                codes, start, row = window_codes(data, at, k)
                if len(start) == 0:
                    continue
                key = pack(codes, k)[start]
                if canonical:
                    key = np.minimum(key, pack_reverse(codes, k)[start])
                rows = pa.array(piece[row])
                place = pa.array(start - at[row] + offset[row])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in keep), place, pa.array(key)], names=[*keep, "pos", "kmer"])

    kinds = dict(reads.dtypes)
    return reads.select(*keep, "sequence").mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keep) + "pos long, kmer long")


def kmer_text(kmer: Column, k: int) -> Column:
    """The text of a packed k-mer: its digits in base four."""
    return F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", SYMBOLS)


def kmer_key(text: Column) -> Column:
    """The packed form of a text of ACGT of at most PACKED_K symbols."""
    return F.conv(F.translate(text, SYMBOLS, "0123"), 4, 10).cast("long")


#: Swaps of neighbouring groups of bits; fixed values.
_SWAPS = ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))


def reverse_key(kmer: Column, k: int) -> Column:
    """The reverse complement of a packed k-mer, by swaps of ever larger groups of bits."""
    x = F.bitwise_not(kmer)
    for by, mask in _SWAPS:
        m = F.lit(mask)
        x = F.shiftrightunsigned(x, by).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), by))
    return F.shiftrightunsigned(x, 64 - 2 * k)


class Codec:
    """Expressions over k-mers that are held as text or packed, so that operators need not know which."""

    def __init__(self, k: int, packed: bool | None = None):
        self.k, self.packed = k, k <= PACKED_K if packed is None else packed

    def key(self, text: Column) -> Column:
        return kmer_key(text) if self.packed else text

    def text(self, kmer: Column, k: int | None = None) -> Column:
        return kmer_text(kmer, k or self.k) if self.packed else kmer

    def prefix(self, kmer: Column) -> Column:
        """The first k-1 symbols."""
        return F.shiftright(kmer, 2) if self.packed else F.substr(kmer, F.lit(1), F.lit(self.k - 1))

    def suffix(self, kmer: Column) -> Column:
        """The last k-1 symbols."""
        return kmer.bitwiseAND(F.lit((1 << 2 * (self.k - 1)) - 1)) if self.packed else F.substr(kmer, F.lit(2))

    def first(self, kmer: Column) -> Column:
        """The place of the first symbol in ACGT, 0 to 3."""
        return F.shiftright(kmer, 2 * (self.k - 1)).cast("int") if self.packed else F.instr(F.lit(SYMBOLS), F.substring(kmer, 1, 1)) - 1

    def last(self, kmer: Column) -> Column:
        return kmer.bitwiseAND(F.lit(3)).cast("int") if self.packed else F.instr(F.lit(SYMBOLS), F.substr(kmer, F.lit(self.k))) - 1

    def before(self, code: int, overlap: Column) -> Column:
        """The k-mer of a symbol and the k-1 after it."""
        return overlap.bitwiseOR(F.lit(code << 2 * (self.k - 1)).cast("long")) if self.packed else F.concat(F.lit(SYMBOLS[code]), overlap)

    def after(self, overlap: Column, code: int) -> Column:
        return F.shiftleft(overlap, 2).bitwiseOR(F.lit(code).cast("long")) if self.packed else F.concat(overlap, F.lit(SYMBOLS[code]))

    def reverse(self, kmer: Column) -> Column:
        """The reverse complement."""
        return reverse_key(kmer, self.k) if self.packed else F.reverse(F.translate(kmer, SYMBOLS, SYMBOLS[::-1]))
