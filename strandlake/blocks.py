"""Keys and counts in blocks: sorted, as differences, by byte planes, compressed.

What would be a shuffled row of 30 bytes a k-mer is a few bytes of a block.  A
task sorts some millions of keys at once and adds up equal ones, so a frequent
key is one entry of each block; blocks are dealt by the keys' mixed top bits,
and one bucket of keys at a time is merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strandlake.arrays import flat, ranges, slices
from strandlake.kmers import PACKED_K, pack, pack_reverse, window_codes
from strandlake.tables import ship_package

#: Keys of a block, and entries of a bucket that is merged at once, about.
BLOCK = 1 << 22
#: Rows of a batch that a kernel gives back.
BATCH = 1 << 16
#: An odd number: multiplying by it permutes keys of any number of bits, and spreads them.
MIX = 0x9E3779B97F4A7C15

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def encoded(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on as compressed byte planes; none is empty."""
    if not len(values):
        return b""
    values = np.ascontiguousarray(values).view(np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def decoded(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    n, width = int.from_bytes(data[:8], "little"), data[8]
    planes = np.frombuffer(pa.decompress(data[9:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(np.int64)


def encoded_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned keys as differences."""
    keys = keys.view(np.uint64)
    return encoded(np.diff(keys, prepend=np.uint64(0)))


def decoded_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(decoded(data).view(np.uint64))


def mixed(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys of ``bits`` bits, permuted and spread, unsigned."""
    return (keys.view(np.uint64) * np.uint64(MIX)) & np.uint64((1 << bits) - 1)


def unmixed(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(pow(MIX, -1, 1 << 64)) & np.uint64((1 << bits) - 1)).view(np.int64)


def buckets_of(rows: DataFrame) -> int:
    """A power of two: buckets among which the k-mers of ``rows`` are dealt, by the size of the tables that are scanned."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())).bit_length()
    # a plan without files has no size
    return 64 if size > 50 else 1 << max(4, min(size + 1 - BLOCK.bit_length(), 14))


def partitions_of(rows: DataFrame, n_buckets: int) -> int:
    return max(rows.sparkSession.sparkContext.defaultParallelism * 2, n_buckets // 2)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, their counts)."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)


def _dealt(keys: np.ndarray, bits: int, n_buckets: int) -> np.ndarray:
    """Places at which the buckets of sorted mixed keys begin, and the end."""
    step = bits - (n_buckets.bit_length() - 1)
    edges = np.arange(1, n_buckets, dtype=np.uint64) << np.uint64(step)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _fit(n_buckets: int, bits: int) -> int:
    return min(n_buckets, 1 << bits)


def kmer_arrays(batches: Iterator[pa.RecordBatch], k: int, canonical: bool) -> Iterator[np.ndarray]:
    """Packed k-mers of the reads, some at a time."""
    for batch in batches:
        for data, at, _, _ in slices(*flat(batch.column("sequence")), k - 1):
            codes, start, _ = window_codes(data, at, k)
            if len(start):
                key = pack(codes, k)[start]
                yield np.minimum(key, pack_reverse(codes, k)[start]) if canonical else key


def counted_kmers(reads: DataFrame, k: int, canonical: bool = False, least: int = 1, block: int | None = None, n_buckets: int | None = None) -> DataFrame:
    """(kmer, count) of the distinct packed k-mers that were found ``least`` times or more."""
    if not 1 <= k <= PACKED_K:
        raise ValueError(f"k must be from 1 to {PACKED_K}")
    ship_package(reads)
    bits, block = 2 * k, block or BLOCK
    n_buckets = _fit(n_buckets or buckets_of(reads), bits)

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = summed(mixed(np.concatenate(held), bits))
        at = _dealt(keys, bits, n_buckets)
        full = np.flatnonzero(np.diff(at))
        parts = [(slice(at[b], at[b + 1])) for b in full]
        return pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array([encoded_sorted(keys[p]) for p in parts], pa.binary()), pa.array([encoded(counts[p] - 1) for p in parts], pa.binary())],
            names=["bucket", "keys", "counts"],
        )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for keys in kmer_arrays(batches, k, canonical):
            held.append(keys)
            size += len(keys)
            if size >= block:
                yield emit(held)
                held, size = [], 0
        if size:
            yield emit(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, ("bucket",)):
            keys, counts = summed(np.concatenate([decoded_sorted(r["keys"]) for r in rows]), np.concatenate([decoded(r["counts"]) + 1 for r in rows]))
            if least > 1:
                keep = counts >= least
                keys, counts = keys[keep], counts[keep]
            keys = unmixed(keys, bits)
            for i in range(0, len(keys), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + BATCH]), pa.array(counts[i : i + BATCH])], names=["kmer", "count"])

    dealt = reads.select("sequence").mapInArrow(deal, "bucket int, keys binary, counts binary")
    dealt = dealt.repartition(partitions_of(reads, n_buckets), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(merge, "kmer long, count long")


def counted_hashes(rows: DataFrame, made: Kernel, by: str | None = None, block: int | None = None, n_buckets: int | None = None) -> DataFrame:
    """(partition, h, count), with ``by`` also (by): how often each hash is found, in each group ``by``.

    made: an Arrow kernel that makes (by, partition, h) from the rows; rows
    without a partition are left out, and a hash has one partition.
    """
    ship_package(rows)
    block, n_buckets = block or BLOCK, n_buckets or buckets_of(rows)
    kind = dict(rows.dtypes)[by] if by else "int"
    arrow = pa.schema(to_arrow_schema(rows.select(by).schema)).field(0).type if by else pa.int32()

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        h = mixed(np.asarray(table.column("h")), 64)
        part = np.asarray(table.column("partition"))
        names = table.column("by").combine_chunks().dictionary_encode("encode") if by else None
        code = np.asarray(names.indices) if by else None
        buckets, groups, blobs = [], [], ([], [], [])
        for g in range(len(names.dictionary)) if by else (0,):
            own = h if code is None else h[code == g]
            owned = part if code is None else part[code == g]
            order = np.argsort(own)
            own, owned = own[order], owned[order]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
            counts = np.diff(np.append(first, len(own)))
            own, owned = own[first], owned[first]
            at = _dealt(own, 64, n_buckets)
            for b in np.flatnonzero(np.diff(at)):
                p = slice(at[b], at[b + 1])
                buckets.append(b)
                groups.append(g)
                for blob, data in zip(blobs, (encoded_sorted(own[p]), encoded(owned[p]), encoded(counts[p] - 1)), strict=True):
                    blob.append(data)
        name = names.dictionary.take(pa.array(groups, pa.int32())) if by else pa.array(groups, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), name.cast(arrow), *(pa.array(b, pa.binary()) for b in blobs)], names=["bucket", "by", "keys", "parts", "counts"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in made(batches):
            own = batch.select([*([by] if by else []), "partition", "h"]).filter(batch.column("partition").is_valid())
            if by:
                own = own.rename_columns(["by", "partition", "h"])
            held.append(own)
            size += own.num_rows
            if size >= block:
                yield emit(held)
                held, size = [], 0
        if size:
            yield emit(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, name), blobs in grouped(batches, ("bucket", "by")):
            keys = np.concatenate([decoded_sorted(r["keys"]) for r in blobs])
            part, counts = (np.concatenate([decoded(r[c]) for r in blobs]) for c in ("parts", "counts"))
            order = np.argsort(keys)
            keys, part, counts = keys[order], part[order], counts[order] + 1
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, part, counts = unmixed(keys[first], 64), part[first], np.add.reduceat(counts, first)
            for i in range(0, len(keys), BATCH):
                cut = slice(i, i + BATCH)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys[cut]), arrow), pa.array(part[cut]), pa.array(keys[cut]), pa.array(counts[cut])], names=["by", "partition", "h", "count"])

    dealt = rows.mapInArrow(deal, f"bucket int, by {kind}, keys binary, parts binary, counts binary")
    dealt = dealt.repartition(partitions_of(rows, n_buckets), "bucket").sortWithinPartitions("bucket", "by")
    out = dealt.mapInArrow(merge, f"by {kind}, partition long, h long, count long")
    return out.withColumnRenamed("by", by) if by else out.drop("by")


def summed_hashes(rows: DataFrame, key: str, weight: str | None = None, block: int | None = None, n_buckets: int | None = None) -> DataFrame:
    """(key, count): rows of a long ``key``, or their ``weight``, added up in blocks; a null key counts as one."""
    ship_package(rows)
    block, n_buckets = block or BLOCK, n_buckets or buckets_of(rows)

    def emit(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = summed(mixed(np.concatenate([k for k, _ in held]), 64), np.concatenate([n for _, n in held]))
        at = _dealt(keys, 64, n_buckets)
        full = np.flatnonzero(np.diff(at))
        parts = [(slice(at[b], at[b + 1])) for b in full]
        return pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array([encoded_sorted(keys[p]) for p in parts], pa.binary()), pa.array([encoded(counts[p]) for p in parts], pa.binary())], names=["bucket", "keys", "counts"]
        )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, unknown = [], 0, 0
        for batch in batches:
            keys, counts = batch.column(0), np.asarray(batch.column(1))
            if keys.null_count:
                known = np.asarray(keys.is_valid())
                unknown += int(counts[~known].sum())
                keys, counts = keys.drop_null(), counts[known]
            held.append((np.asarray(keys), counts))
            size += len(counts)
            if size >= block:
                yield emit(held)
                held, size = [], 0
        if size:
            yield emit(held)
        if unknown:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.binary()), pa.array([encoded(np.array([unknown]))], pa.binary())], names=["bucket", "keys", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), blobs in grouped(batches, ("bucket",)):
            counts = np.concatenate([decoded(r["counts"]) for r in blobs])
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([int(counts.sum())])], names=[key, "count"])
                continue
            keys, counts = summed(np.concatenate([decoded_sorted(r["keys"]) for r in blobs]), counts)
            keys = unmixed(keys, 64)
            for i in range(0, len(keys), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + BATCH]), pa.array(counts[i : i + BATCH])], names=[key, "count"])

    own = rows.select(F.col(key).cast("long").alias("k"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("n"))
    dealt = own.mapInArrow(deal, "bucket int, keys binary, counts binary").repartition(partitions_of(rows, n_buckets), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(merge, f"`{key}` long, count long")


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows, as dicts, of each run of equal ``keys``."""
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[c] for c in keys)
            if own != at:
                if held:
                    yield at, held
                at, held = own, []
            held.append(row)
    if held:
        yield at, held


class Placed:
    """The k-mers of a chunk of reads, in order of reads and places, with what was found of each."""

    def __init__(self, seq_no: np.ndarray, data: np.ndarray, at: np.ndarray, row: np.ndarray, pos: np.ndarray, keys: np.ndarray, counts: np.ndarray, names: list | None):
        self.names = names
        self.seq_no, self.data, self.at, self.row, self.pos, self.keys, self.counts = seq_no, data, at, row, pos, keys, counts

    def per_read(self, weights: np.ndarray | None = None) -> np.ndarray:
        """K-mers of each read, or those of a true weight."""
        return np.bincount(self.row if weights is None else self.row[weights], minlength=len(self.seq_no))

    def lists(self, values: np.ndarray, kept: np.ndarray) -> pa.Array:
        """``values`` of the k-mers by read, of the reads ``kept``, which are those that have k-mers."""
        ends = np.cumsum(self.per_read())[kept]
        return pa.LargeListArray.from_arrays(np.concatenate(([0], ends)), pa.array(values)).cast(pa.list_(pa.from_numpy_dtype(values.dtype)))

    def runs(self, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) of maximal runs of flagged places; end is exclusive."""
        row, pos = self.row[flag], self.pos[flag]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1))) if len(row) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1 if len(first) else first
        return row[first], pos[first], pos[last] + 1

    def texts(self, row: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> pa.Array:
        """The text under runs of k-mers."""
        size = end - start + k - 1
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        text = np.ascontiguousarray(self.data[ranges(self.at[row] + start, size)])
        return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(text)).cast(pa.string())


def placed_counts(reads: DataFrame, k: int, finish: Callable[[Placed], pa.RecordBatch], schema: str, running: bool = False, named: str | None = None, block: int | None = None, n_buckets: int | None = None) -> DataFrame:
    """``finish`` of every chunk of reads (seq_no, sequence): its k-mers, each with its count in all reads.

    running: the count is that of the places up to this one, in order of reads.
    named: a text column that the chunks keep for each read.
    Chunks are stored, their distinct k-mers dealt to buckets and added up there
    (or summed in order of chunks), and the sums, in the order of a chunk's
    k-mers, sent back to it.  No k-mer travels with its places, so neither a
    frequent k-mer nor a long read is gathered in one task.
    """
    from strandlake.tables import stored

    if not 1 <= k <= PACKED_K:
        raise ValueError(f"k must be from 1 to {PACKED_K}")
    ship_package(reads)
    bits, block = 2 * k, block or BLOCK
    n_buckets = _fit(n_buckets or buckets_of(reads), bits)
    n_parts = partitions_of(reads, n_buckets)

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = (context.partitionId() if context else 0) << 32
        held, size = [], 0

        def made() -> pa.RecordBatch:
            seq_no = np.concatenate([h[0] for h in held])
            data = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            names = [x for h in held for x in h[3]] if named else None
            row = [[int(seq_no[0])], [part], [encoded(seq_no.view(np.uint64))], [encoded(sizes)], [len(data)], [pa.compress(data.tobytes(), codec="zstd", asbytes=True)], [names]]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names=["first", "part", "seq_no", "sizes", "n", "text", "names"])

        for batch in batches:
            data, at = flat(batch.column("sequence"))
            seq_no = np.asarray(batch.column("seq_no")).astype(np.int64)
            begin = 0
            while begin < len(seq_no):
                end = min(len(seq_no), max(begin + 1, int(np.searchsorted(at, at[begin] + block - size, "right")) - 1))
                held.append((seq_no[begin:end], data[at[begin] : at[end]], np.diff(at[begin : end + 1]), batch.column(named).slice(begin, end - begin).to_pylist() if named else None))
                size += int(at[end] - at[begin])
                begin = end
                if size >= block or begin < len(seq_no):
                    yield made()
                    held, size, part = [], 0, part + 1
        if held:
            yield made()

    def opened(row: dict) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(pa.decompress(row["text"], row["n"], codec="zstd", asbytes=True), np.uint8) if row["n"] else np.zeros(0, np.uint8)
        at = np.concatenate(([0], np.cumsum(decoded(row["sizes"]))))
        codes, start, place = window_codes(data, at, k)
        return data, at, start - at[place], place, pack(codes, k)[start] if len(start) else np.zeros(0, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = summed(mixed(opened(row)[-1], bits))
                at = _dealt(keys, bits, n_buckets)
                full = np.flatnonzero(np.diff(at))
                parts = [(slice(at[b], at[b + 1])) for b in full]
                n = len(full)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), pa.array(np.full(n, row["first"])), pa.array(np.full(n, row["part"])), pa.array([encoded_sorted(keys[p]) for p in parts], pa.binary()), pa.array([encoded(counts[p] - 1) for p in parts], pa.binary())],
                    names=["bucket", "first", "part", "keys", "counts"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in grouped(batches, ("bucket",)):
            blocks = [decoded_sorted(r["keys"]) for r in rows]
            ends = np.cumsum([len(b) for b in blocks])
            keys, counts = np.concatenate(blocks), np.concatenate([decoded(r["counts"]) + 1 for r in rows])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.concatenate(([True], keys[1:] != keys[:-1]))
            begin = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            if running:
                before = np.cumsum(counts) - counts
                found = before - before[begin][group]
            else:
                found = np.add.reduceat(counts, begin)[group]
            out = np.empty(len(order), np.int64)
            out[order] = found
            for r, end, own in zip(rows, ends, blocks, strict=True):
                row = [[r["first"]], [r["part"]], [bucket], [encoded(out[end - len(own) : end])]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["first", "part", "bucket", "found"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, ("first", "part")):
            seq_no = decoded(rows[0]["seq_no"])
            data, at, pos, row, keys = opened(rows[0])
            order = np.argsort(mixed(keys, bits), kind="stable")
            own = keys[order]
            new = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            found = np.concatenate([decoded(r["found"]) for r in rows[1:]]) if len(rows) > 1 else np.zeros(0, np.int64)
            counts = np.empty(len(keys), np.int64)
            counts[order] = found[group] + (np.arange(1, len(own) + 1) - np.flatnonzero(new)[group] if running else 0)
            out = finish(Placed(seq_no, data, at, row, pos, keys, counts, rows[0]["names"]))
            for i in range(0, out.num_rows, BATCH):
                yield out.slice(i, BATCH)

    rows = reads.select(F.col("seq_no").cast("long").alias("seq_no"), "sequence", *([named] if named else []))
    if running:
        rows = rows.repartitionByRange(n_parts, "seq_no").sortWithinPartitions("seq_no")
    chunks = stored(rows.mapInArrow(chunk, "first long, part long, seq_no binary, sizes binary, n long, text binary, names array<string>"), "chunks")
    found = chunks.select("first", "part", "sizes", "n", "text").mapInArrow(deal, "bucket int, first long, part long, keys binary, counts binary")
    found = found.repartition(n_parts, "bucket").sortWithinPartitions("bucket", "first", "part").mapInArrow(answer, "first long, part long, bucket int, found binary")
    both = chunks.selectExpr("first", "part", "-1 as bucket", "seq_no", "sizes", "n", "text", "names", "cast(null as binary) as found").unionByName(
        found.selectExpr("first", "part", "bucket", "cast(null as binary) as seq_no", "cast(null as binary) as sizes", "cast(null as long) as n", "cast(null as binary) as text", "cast(null as array<string>) as names", "found")
    )
    return both.repartition(n_parts, "first", "part").sortWithinPartitions("first", "part", "bucket").mapInArrow(back, schema)
