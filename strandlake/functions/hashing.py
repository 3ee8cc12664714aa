"""Strand-aware k-mer hashes.

A k-mer's hash is the exclusive or of its symbols' constants, each rotated by its
distance from the end.  For all k-mers of a sequence it follows from prefix sums:
with P[j] the exclusive or of constants rotated back by their place,
hash(i) = rotl(P[i+k] ^ P[i], i+k-1).  Hashes are 64-bit and unsigned; columns
hold the same bits as signed longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.arrays import flat, slices, window_starts
from strandlake.tables import ship_package

#: Constants of the symbols; fixed values.
SYMBOL_HASH = {
    "A": 16664410744025174816,
    "C": 15956807086001210932,
    "G": 9404339731978646439,
    "T": 836480985777824379,
    "N": 10780076607752328646,
}
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}
_SIGN = -(1 << 63)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    own, other = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
    for s, h in SYMBOL_HASH.items():
        own[ord(s)], other[ord(s)] = h, SYMBOL_HASH[COMPLEMENT[s]]
    return own, other


_OWN, _OTHER = _tables()


def rotl(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = (np.asarray(by) % 64).astype(np.uint64)
    return (x << by) | (x >> ((np.uint64(64) - by) % np.uint64(64)))


def sequence_hashes(sequence: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(forward, reverse-complement) hashes of every k-mer of a byte array."""
    n = len(sequence) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    place = np.arange(len(sequence))
    p = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(rotl(_OWN[sequence], -place))))
    q = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(rotl(_OTHER[sequence], place))))
    i = np.arange(n)
    return rotl(p[k:] ^ p[:-k], i + k - 1), rotl(q[k:] ^ q[:-k], -i)


def kmer_hash(kmer: str) -> tuple[int, int]:
    """(forward, reverse-complement) hash of one k-mer."""
    fw, rc = sequence_hashes(np.frombuffer(kmer.encode(), np.uint8), len(kmer))
    return int(fw[0]), int(rc[0])


def unsigned_key(h: Column) -> Column:
    """A long that orders as the unsigned value of ``h``."""
    return h.bitwiseXOR(F.lit(_SIGN))


def unsigned_min(a: Column, b: Column) -> Column:
    return unsigned_key(F.least(unsigned_key(a), unsigned_key(b)))


def unsigned_mod(h: Column, m: int) -> Column:
    """The unsigned value of ``h`` modulo ``m``."""
    return F.pmod(F.pmod(h, F.lit(m)) + F.when(h < 0, F.lit((1 << 64) % m)).otherwise(F.lit(0)), F.lit(m))


def unsigned_text(h: Column) -> Column:
    """The unsigned value of ``h`` in decimal digits."""
    wide = h.cast("decimal(20,0)")
    return F.when(h < 0, wide + F.expr("18446744073709551616BD")).otherwise(wide).cast("decimal(20,0)").cast("string")


def canonical(fw: Column, rc: Column) -> Column:
    """STRUCT(fw, rc, value, sign): the lesser unsigned hash, and whether it is the forward one."""
    return F.struct(fw.alias("fw"), rc.alias("rc"), unsigned_min(fw, rc).alias("value"), (unsigned_key(fw) < unsigned_key(rc)).alias("sign"))


def hash_expression(kmer: Column, k: int) -> Column:
    """Forward hash of a k-mer column by built-in functions alone."""

    def step(h: Column, c: Column) -> Column:
        turned = F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63))
        value = F.lit(0).cast("long")
        for s, x in SYMBOL_HASH.items():
            value = F.when(c == s, F.lit(x - (1 << 64) if x >> 63 else x)).otherwise(value)
        return turned.bitwiseXOR(value)

    return F.aggregate(F.split(F.substring(kmer, 1, k), ""), F.lit(0).cast("long"), step)


def packed_hash_expression(kmer: Column, k: int) -> Column:
    """Forward hash of a packed k-mer by built-in functions alone: each four symbols are looked up in a table of their part of it."""
    out = None
    for first in range(0, k, 4):
        n = min(4, k - first)
        table = []
        for code in range(4**n):
            h = 0
            for i in range(n):
                x, by = SYMBOL_HASH["ACGT"[code >> 2 * (n - 1 - i) & 3]], (k - 1 - first - i) % 64
                h ^= (x << by | x >> (64 - by)) & ((1 << 64) - 1)
            table.append(h - (1 << 64) if h >> 63 else h)
        own = F.get(F.lit(table), F.shiftrightunsigned(kmer, 2 * (k - first - n)).bitwiseAND(F.lit(4**n - 1)).cast("int"))
        out = own if out is None else out.bitwiseXOR(own)
    return out


def extensions(kmer: Column, side: str) -> Column:
    """Array of (symbol, kmer) of the four neighbours on one side."""

    def make(s: str) -> Column:
        near = F.concat(F.substr(kmer, F.lit(2)), F.lit(s)) if side == "right" else F.concat(F.lit(s), F.substr(kmer, F.lit(1), F.length(kmer) - 1))
        return F.struct(F.lit(s).alias("symbol"), near.alias("kmer"))

    return F.array(*map(make, "ACGT"))


def hashed_kmers(reads: DataFrame, k: int, keep: tuple[str, ...] = ("seq_no",)) -> DataFrame:
    """(*keep, pos, fw, rc, h) of every k-mer; h is the canonical value.

    Vectorised over whole Arrow batches: prefix sums run through all sequences of
    a slice, and only windows within one sequence are taken.
    """
    ship_package(reads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, at, piece, offset in slices(*flat(batch.column("sequence")), k - 1):
                start, row = window_starts(at, k)
                if len(start) == 0:
                    continue
                fw, rc = (h[start] for h in sequence_hashes(data, k))
                rows = pa.array(piece[row])
                columns = [start - at[row] + offset[row], fw.view(np.int64), rc.view(np.int64), np.minimum(fw, rc).view(np.int64)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in keep), *map(pa.array, columns)], names=[*keep, "pos", "fw", "rc", "h"])

    kinds = dict(reads.dtypes)
    return reads.select(*keep, "sequence").mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keep) + "pos long, fw long, rc long, h long")


def max_hash_for_scaled(scaled: int) -> int:
    """Largest hash that a scaled sketch keeps; 0 for no scaling."""
    top = (1 << 64) - 1
    return 0 if scaled == 0 else top if scaled == 1 else int(top / scaled)


def primes_near(n: int, x: int) -> list[int]:
    """The n largest odd primes below x, descending: sizes of hash tables."""
    out, c = [], (x - 1) | 1
    c = c if c < x else c - 2
    while len(out) < n and c > 2:
        if all(c % d for d in range(3, int(c**0.5) + 1, 2)):
            out.append(c)
        c -= 2
    return out


# --- hashes of neighbours and of other lengths, from a k-mer's own


def _turned(h: Column, by: int) -> Column:
    by %= 64
    return h if by == 0 else F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by))


def _value(symbol: Column, complement: bool = False) -> Column:
    """The constant of a symbol, or of its complement."""
    out = F.lit(0).cast("long")
    for s in SYMBOL_HASH:
        x = SYMBOL_HASH[COMPLEMENT[s] if complement else s]
        out = F.when(symbol == s, F.lit(x - (1 << 64) if x >> 63 else x)).otherwise(out)
    return out


def extended(h: Column, symbol: Column) -> Column:
    """The hash of a k-mer and one more symbol at its end."""
    return _turned(h, 1).bitwiseXOR(_value(symbol))


def prepended(h: Column, symbol: Column, k: int) -> Column:
    """The hash of a symbol and the k symbols of ``h`` after it."""
    return h.bitwiseXOR(_turned(_value(symbol), k))


def without_first(h: Column, symbol: Column, k: int) -> Column:
    """The hash of a k-mer without its first symbol, which is given."""
    return h.bitwiseXOR(_turned(_value(symbol), k - 1))


def without_last(h: Column, symbol: Column) -> Column:
    """The hash of a k-mer without its last symbol, which is given."""
    return _turned(h.bitwiseXOR(_value(symbol)), 63)


def hashed_extensions(kmer: Column, fw: Column, rc: Column, k: int, side: str) -> Column:
    """Array of (side, symbol, kmer, fw, rc) of the four neighbours on one side, their hashes rolled from the k-mer's two."""
    first, last = F.substring(kmer, 1, 1), F.substr(kmer, F.lit(k))

    def make(near: Column) -> Column:
        s = near["symbol"]
        if side == "right":
            f = extended(without_first(fw, first, k), s)
            r = without_last(rc, F.translate(first, "ACGT", "TGCA")).bitwiseXOR(_turned(_value(s, True), k - 1))
        else:
            f = without_last(fw, last).bitwiseXOR(_turned(_value(s), k - 1))
            r = _turned(without_first(rc, F.translate(last, "ACGT", "TGCA"), k), 1).bitwiseXOR(_value(s, True))
        return F.struct(F.lit(side).alias("side"), s.alias("symbol"), near["kmer"].alias("kmer"), f.alias("fw"), r.alias("rc"))

    return F.transform(extensions(kmer, side), make)
