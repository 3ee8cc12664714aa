"""Universal hitting sets: w-mers dealt to partitions by the least k-mer of a set that they hold.

A set is a table (kmer, h, partition): texts, their hashes, and partitions by
first appearance.  It is small (at most MOST k-mers, which is checked), so tasks
get it whole; w-mers of larger sets come from ``tags.window_minimizers``, a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.arrays import flat, slices, window_starts
from strandlake.blocks import Kernel
from strandlake.functions.hashing import sequence_hashes
from strandlake.kmers import SYMBOLS
from strandlake.tables import ship_package

#: K-mers of a set at most: all of ten symbols.
MOST = 1 << 20


def text_hashes(texts: list[str], k: int, canonical: bool) -> np.ndarray:
    """Unsigned hashes of k-symbol texts."""
    if not texts:
        return np.zeros(0, np.uint64)
    fw, rc = sequence_hashes(np.frombuffer("".join(texts).encode(), np.uint8), k)
    fw, rc = fw[::k], rc[::k]
    return np.minimum(fw, rc) if canonical else fw


def hitting_set(spark: SparkSession, texts: list[str], k: int, canonical: bool = False) -> DataFrame:
    """(kmer, h, partition) of listed k-mers; one whose hash came before has the partition of that."""
    if len(texts) > MOST:
        raise ValueError("a hitting set that is sent to all tasks is bounded")
    if any(len(t) != k for t in texts):
        raise ValueError(f"k-mers of a set have {k} symbols")
    h = text_hashes(texts, k, canonical)
    _, first, place = np.unique(h, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    rows = list(zip(texts, h.view(np.int64).tolist(), rank[place.reshape(-1)].tolist(), strict=True))
    return spark.createDataFrame(rows, "kmer string, h long, partition long")


def load_hitting_set(spark: SparkSession, path: str, k: int, canonical: bool = False) -> DataFrame:
    """The set of a file of k-mers, one a line (compressed or not), in order of lines."""
    rows = spark.read.text(path).select(F.trim(F.upper("value")).alias("v"), F.monotonically_increasing_id().alias("i")).where("v <> ''")
    return hitting_set(spark, [r.v for r in rows.orderBy("i").limit(MOST + 1).toLocalIterator()], k, canonical)


def decycling_set(k: int) -> list[str]:
    """K-mers without which no endless sequence can be written, one of each class of rotations.

    The rule of the least such sets: with symbols as weights on the k-th roots of
    unity, rotating turns their sum by one step, so one rotation of each class is
    the first whose sum is above the real axis; where the sum is zero, the least
    rotation is taken.  What a k-mer loses has a real weight, so no sequence comes
    above the axis other than through such a k-mer.
    """
    codes = np.arange(1 << 2 * k)
    digits = (codes[:, None] >> (2 * np.arange(k - 1, -1, -1))) & 3
    root = np.exp(2j * np.pi * np.arange(k) / k)
    total = (digits * root).sum(axis=1)
    turn = np.angle(total) + 1e-9
    zero = np.abs(total) < 1e-9
    least, other = codes.copy(), codes
    for _ in range(k - 1):
        other = ((other << 2) & ((1 << 2 * k) - 1)) | (other >> 2 * (k - 1))
        least = np.minimum(least, other)
    chosen = np.where(zero, codes == least, (turn >= np.pi - 2 * np.pi / k) & (turn < np.pi))
    return ["".join(SYMBOLS[d] for d in digits[i]) for i in np.flatnonzero(chosen)]


def n_rotation_classes(k: int) -> int:
    """Classes of k-mers that are rotations of one another."""
    return sum(4 ** math.gcd(i, k) for i in range(k)) // k


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def wmers(reads: DataFrame, w: int, k: int, hits: DataFrame, canonical: bool = False, keep: tuple[str, ...] = ("seq_no",)) -> DataFrame:
    """(*keep, pos, h, minimizer, partition) of every w-mer: its hash, and the least-hashing k-mer of the set inside it.

    A w-mer that holds none has a null minimizer and partition.
    """
    kinds = dict(reads.dtypes)
    return reads.select(*keep, "sequence").mapInArrow(wmer_kernel(reads, w, k, hits, canonical, keep), "".join(f"`{c}` {kinds[c]}, " for c in keep) + "pos long, h long, minimizer long, partition long")


def wmer_kernel(reads: DataFrame, w: int, k: int, hits: DataFrame, canonical: bool = False, keep: tuple[str, ...] = ("seq_no",)) -> Kernel:
    """The Arrow kernel of ``wmers``."""
    if w < k:
        raise ValueError("w must be at least k")
    ship_package(reads)
    listed = hits.select("h", "partition").distinct().limit(MOST + 1).collect()
    if len(listed) > MOST:
        raise ValueError("a hitting set that is sent to all tasks is bounded")
    pairs = sorted((r.h % (1 << 64), r.partition) for r in listed)
    known = np.array([p[0] for p in pairs], np.uint64)
    part = np.array([p[1] for p in pairs], np.int64)
    shared = reads.sparkSession.sparkContext.broadcast((known, part))
    none = np.uint64((1 << 64) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = shared.value
        for batch in batches:
            for data, at, piece, offset in slices(*flat(batch.column("sequence")), w - 1):
                start, row = window_starts(at, w)
                if len(start) == 0:
                    continue
                fw, rc = sequence_hashes(data, k)
                h = np.minimum(fw, rc) if canonical else fw
                rank = np.searchsorted(known, h).astype(np.uint64)
                inside = rank < len(known)
                hit = np.zeros(len(h), bool)
                hit[inside] = known[rank[inside].astype(np.int64)] == h[inside]
                least = sliding_min(np.where(hit, rank, none), w - k + 1)[start]
                found = least != none
                place = np.where(found, least, 0).astype(np.int64)
                wide_fw, wide_rc = sequence_hashes(data, w)
                wide = (np.minimum(wide_fw, wide_rc) if canonical else wide_fw)[start]
                rows = pa.array(piece[row])
                values = known[place].view(np.int64) if len(known) else np.zeros(len(place), np.int64)
                parts = part[place] if len(known) else np.zeros(len(place), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(rows) for c in keep), pa.array(start - at[row] + offset[row]), pa.array(wide.view(np.int64)), pa.array(values, mask=~found), pa.array(parts, mask=~found)],
                    names=[*keep, "pos", "h", "minimizer", "partition"],
                )

    return run


def neighbour_wmers(kmers: DataFrame, w: int, k: int, hits: DataFrame, side: str = "right", canonical: bool = False) -> DataFrame:
    """(kmer, symbol, h, minimizer, partition): the four w-mers to one side of each, with their minimizers."""
    near = (lambda s: F.concat(F.substr("kmer", F.lit(2)), F.lit(s))) if side == "right" else (lambda s: F.concat(F.lit(s), F.substr("kmer", F.lit(1), F.lit(w - 1))))
    rows = kmers.select("kmer", F.explode(F.array(*[F.struct(F.lit(s).alias("symbol"), near(s).alias("sequence")) for s in SYMBOLS])).alias("x")).select("kmer", "x.symbol", "x.sequence")
    return wmers(rows, w, k, hits, canonical, ("kmer", "symbol")).drop("pos")


def tag_edges(wmer: DataFrame) -> DataFrame:
    """(left, right, left_partition, right_partition) of distinct neighbouring w-mers, in reads, of different partitions: tags."""
    step = Window.partitionBy("seq_no").orderBy("pos")
    ahead = lambda c: F.lead(c).over(step)
    rows = wmer.select("h", "partition", (ahead("pos") == F.col("pos") + 1).alias("next"), ahead("h").alias("right"), ahead("partition").alias("q"))
    return rows.where("next and q <> partition").select(F.col("h").alias("left"), "right", F.col("partition").alias("left_partition"), F.col("q").alias("right_partition")).distinct()
