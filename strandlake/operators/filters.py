"""Read filters by k-mer abundance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.blocks import MIX, Placed, decoded_sorted, encoded_sorted, placed_counts
from strandlake.functions.hashing import sequence_hashes
from strandlake.kmers import PACKED_K
from strandlake.tables import ship_package

#: Reads of a block, within which the places of one k-mer are sorted together.
BLOCK = 4096


def running_counts(kmers: DataFrame, key: str = "kmer", block: int = BLOCK) -> DataFrame:
    """kmers with ``count``: how often the key was inserted up to and including this one, in read order.

    A frequent k-mer is ranked by blocks of reads, and the counts of the blocks
    before are added, so that its places are never sorted in one task.
    """
    rows = kmers.withColumn("__b", F.floor(F.col("seq_no") / block))
    totals = rows.groupBy(key, "__b").agg(F.count("*").alias("__n"))
    before = totals.withColumn("__before", F.sum("__n").over(Window.partitionBy(key).orderBy("__b")) - F.col("__n")).where("__before > 0").drop("__n")
    rank = F.row_number().over(Window.partitionBy(key, "__b").orderBy("seq_no", "pos"))
    joined = rows.withColumn("__r", rank).join(before, [key, "__b"], "left")
    return joined.withColumn("count", F.col("__r") + F.coalesce("__before", F.lit(0))).select(*kmers.columns, "count")


def first_places(kmers: DataFrame, n: int = 1, key: str = "kmer", block: int = BLOCK) -> DataFrame:
    """(key, seq_no, pos) of the first ``n`` places of every k-mer in read order; only n a block of reads go on."""
    place = F.struct("seq_no", "pos")
    if n == 1:
        return kmers.groupBy(key).agg(F.min(place).alias("p")).select(key, "p.seq_no", "p.pos")
    rows = kmers.select(key, "seq_no", "pos")
    for by in ([key, F.floor(F.col("seq_no") / block)], [key]):
        rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("seq_no", "pos"))).where(F.col("__r") <= n).drop("__r")
    return rows


def solid_reads(kmers: DataFrame, threshold: int, min_prop: float, key: str = "kmer") -> DataFrame:
    """(seq_no, n_kmers, n_low, passed): a read is rejected if its share of k-mers below the
    threshold, counted after its own insertion, is at least 1 - min_prop (so 1.0 rejects all).

    The k-mers below the threshold are those at the first threshold - 1 places of
    their kind, so no k-mer's later places are ever sorted.
    """
    every = kmers.groupBy("seq_no").agg(F.count("*").alias("n_kmers"))
    if threshold <= 1:
        out = every.withColumn("n_low", F.lit(0).cast("long"))
    else:
        low = first_places(kmers, threshold - 1, key).groupBy("seq_no").agg(F.count("*").alias("n_low"))
        out = every.join(low, "seq_no", "left").withColumn("n_low", F.coalesce("n_low", F.lit(0)))
    return out.withColumn("passed", ~(F.col("n_low") / F.col("n_kmers") >= 1 - min_prop))


def count_vectors(kmers: DataFrame, store: DataFrame, key: str = "kmer") -> DataFrame:
    """(seq_no, counts): the count in a store of every k-mer of a read, in order of place; 0 where it has none."""
    joined = kmers.join(store, key, "left").select("seq_no", F.struct("pos", F.coalesce("count", F.lit(0)).alias("count")).alias("x"))
    rows = joined.groupBy("seq_no").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rows.select("seq_no", F.transform("xs", lambda x: x["count"]).alias("counts"))


def new_kmers(kmers: DataFrame, store: DataFrame, key: str = "kmer") -> DataFrame:
    """K-mers of reads that a store does not have."""
    return kmers.join(store.select(key), key, "left_anti")


def median_at_least(kmers: DataFrame, store: DataFrame, cutoff: int, key: str = "kmer") -> DataFrame:
    """(seq_no, passed): at least floor(0.5 + n/2) of a read's k-mers have count >= cutoff in a fixed store."""
    joined = kmers.join(store, key, "left")
    n = F.count("*")
    high = F.count_if(F.coalesce(F.col("count"), F.lit(0)) >= cutoff)
    return joined.groupBy("seq_no").agg((high >= F.floor(0.5 + n / 2)).alias("passed"))


def median_in_range(kmers: DataFrame, store: DataFrame, low: int, high: int, key: str = "kmer", hashes: bool = False) -> DataFrame:
    """(seq_no, median, passed): upper median with low < median <= high; with ``hashes`` also the read's keys in order of place."""
    joined = kmers.join(store, key, "left").withColumn("count", F.coalesce("count", F.lit(0)))
    keys = [F.transform(F.array_sort(F.collect_list(F.struct("pos", key))), lambda x: x[key]).alias("hashes")] if hashes else []
    rows = joined.groupBy("seq_no").agg(F.sort_array(F.collect_list("count")).alias("c"), *keys)
    rows = rows.select("seq_no", F.element_at("c", (F.size("c") / 2).cast("int") + 1).alias("median"), *(["hashes"] if hashes else []))
    return rows.withColumn("passed", (F.col("median") > low) & (F.col("median") <= high))


def segments(flagged: DataFrame, flag: str = "flag") -> DataFrame:
    """(seq_no, start, end) of maximal runs of flagged positions; end is exclusive."""
    rows = flagged.where(F.col(flag))
    island = F.col("pos") - F.row_number().over(Window.partitionBy("seq_no").orderBy("pos"))
    return rows.withColumn("island", island).groupBy("seq_no", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("island")


def solid_segments(kmers: DataFrame, store: DataFrame, min_abundance: int, key: str = "kmer") -> DataFrame:
    return segments(kmers.join(store, key).withColumn("flag", F.col("count") >= min_abundance))


def new_segments(kmers: DataFrame, key: str = "kmer") -> DataFrame:
    """Runs of k-mers that no earlier position held."""
    return segments(first_places(kmers, 1, key).withColumn("flag", F.lit(True)))


def segment_sequences(reads: DataFrame, segment: DataFrame, k: int) -> DataFrame:
    """(seq_no, start, sequence) of the text under segments of k-mer positions."""
    rows = reads.select("seq_no", "sequence").join(segment, "seq_no")
    return rows.select("seq_no", "start", F.substr("sequence", F.col("start") + 1, F.col("end") - F.col("start") + k - 1).alias("sequence"))


# --- of whole reads, whose k-mers do not travel with their places


def _lengths(seen: Placed) -> tuple[np.ndarray, np.ndarray]:
    """(whether a read has k-mers, how many those have that do)."""
    n = seen.per_read()
    return n > 0, n[n > 0]


def read_summaries(reads: DataFrame, k: int) -> DataFrame:
    """(seq_no, n_kmers, most, n_new) of reads with k-mers: the highest running count, and how many places were the first of their k-mer."""

    def finish(seen: Placed) -> pa.RecordBatch:
        kept, n = _lengths(seen)
        most = np.maximum.reduceat(seen.counts, np.cumsum(n) - n) if len(n) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (seen.seq_no[kept], n, most, seen.per_read(seen.counts == 1)[kept])], names=["seq_no", "n_kmers", "most", "n_new"])

    return placed_counts(reads, k, finish, "seq_no long, n_kmers long, most long, n_new long", running=True).groupBy("seq_no").agg(F.sum("n_kmers").alias("n_kmers"), F.max("most").alias("most"), F.sum("n_new").alias("n_new"))


def solid_whole_reads(reads: DataFrame, k: int, threshold: int, min_prop: float) -> DataFrame:
    """As ``solid_reads``, of reads."""

    def finish(seen: Placed) -> pa.RecordBatch:
        kept, n = _lengths(seen)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (seen.seq_no[kept], n, seen.per_read(seen.counts < threshold)[kept])], names=["seq_no", "n_kmers", "n_low"])

    out = placed_counts(reads, k, finish, "seq_no long, n_kmers long, n_low long", running=True).groupBy("seq_no").agg(F.sum("n_kmers").alias("n_kmers"), F.sum("n_low").alias("n_low"))
    return out.withColumn("passed", ~(F.col("n_low") / F.col("n_kmers") >= 1 - min_prop))


def read_counts(reads: DataFrame, k: int, hashes: bool = False) -> DataFrame:
    """(seq_no, counts), with ``hashes`` also (hashes): how often each k-mer of a read is found in all reads, in order of place, and the packed k-mers."""

    def finish(seen: Placed) -> pa.RecordBatch:
        kept, _ = _lengths(seen)
        columns = [pa.array(seen.seq_no[kept]), seen.lists(seen.counts, kept), *([seen.lists(seen.keys, kept)] if hashes else [])]
        return pa.RecordBatch.from_arrays(columns, names=["seq_no", "counts", *(["hashes"] if hashes else [])])

    return placed_counts(reads, k, finish, "seq_no long, counts array<long>" + (", hashes array<long>" if hashes else ""))


def read_medians(reads: DataFrame, k: int, low: int, high: int, hashes: bool = False) -> DataFrame:
    """As ``median_in_range`` with the store of all reads."""
    rows = read_counts(reads, k, hashes).withColumn("median", F.element_at(F.sort_array("counts"), F.floor(F.size("counts") / 2).cast("int") + 1))
    return rows.select("seq_no", "median", *(["hashes"] if hashes else []), ((F.col("median") > low) & (F.col("median") <= high)).alias("passed"))


def reads_at_least(reads: DataFrame, k: int, cutoff: int) -> DataFrame:
    """As ``median_at_least`` with the store of all reads."""

    def finish(seen: Placed) -> pa.RecordBatch:
        kept, n = _lengths(seen)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (seen.seq_no[kept], n, seen.per_read(seen.counts >= cutoff)[kept])], names=["seq_no", "n", "high"])

    out = placed_counts(reads, k, finish, "seq_no long, n long, high long").groupBy("seq_no").agg(F.sum("n").alias("n"), F.sum("high").alias("high"))
    return out.select("seq_no", (F.col("high") >= F.floor(0.5 + F.col("n") / 2)).alias("passed"))


def read_segments(reads: DataFrame, k: int, min_abundance: int | None = None, sequences: bool = False) -> DataFrame:
    """(seq_no, start, end) of runs of k-mers found ``min_abundance`` times or more, or (None) of those no earlier place held; with ``sequences`` their text in place of the end."""
    new = min_abundance is None

    def finish(seen: Placed) -> pa.RecordBatch:
        row, start, end = seen.runs(seen.counts == 1 if new else seen.counts >= min_abundance)
        last = seen.texts(row, start, end, k) if sequences else pa.array(end)
        return pa.RecordBatch.from_arrays([pa.array(seen.seq_no[row]), pa.array(start), last], names=["seq_no", "start", "sequence" if sequences else "end"])

    return placed_counts(reads, k, finish, "seq_no long, start long, " + ("sequence string" if sequences else "end long"), running=new)


class _Counts:
    """Counts of k-mer keys in an open-addressed table, that is asked and filled for all keys of a read at once."""

    def __init__(self, bits: int = 12):
        self.bits, self.size = bits, 0
        self.keys, self.counts = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)  # a count of 0: no key

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def at_least(self, keys: np.ndarray, cutoff: int) -> int:
        if cutoff <= 0:
            return len(keys)
        at, total, last = self._slots(keys), 0, len(self.keys) - 1
        while len(keys):
            counts = self.counts[at]
            hit = (self.keys[at] == keys) & (counts > 0)
            total += int(np.count_nonzero(counts[hit] >= cutoff))
            on = ~hit & (counts > 0)
            keys, at = keys[on], (at[on] + 1) & last
        return total

    def add(self, keys: np.ndarray) -> None:
        keys, n = np.unique(keys, return_counts=True)
        while 2 * (self.size + len(keys)) > len(self.keys):
            full = self.counts > 0
            own, counts = self.keys[full], self.counts[full]
            self.__init__(self.bits + 1)
            self._put(own, counts)
        self._put(keys, n)

    def _put(self, keys: np.ndarray, n: np.ndarray) -> None:
        """Distinct keys and what is added to their counts."""
        at, last = self._slots(keys), len(self.keys) - 1
        while len(keys):
            free = self.counts[at] == 0
            # of keys that claim one place the last gets it; the others go on
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.size += int(np.count_nonzero(mine & free))
            self.counts[at[mine]] += n[mine].astype(np.int32)
            keys, n, at = keys[~mine], n[~mine], (at[~mine] + 1) & last


def digital_normalisation(reads: DataFrame, k: int, cutoff: int, sample: str = "sample") -> DataFrame:
    """(sample, seq_no, n_kmers, passed) of exact digital normalisation within each sample.

    A read is rejected if at least floor(0.5 + n/2) of its k-mers have been counted
    ``cutoff`` times; rejected reads are not counted, so each verdict changes what
    later reads see.  A sample is thus one ordered pass, samples side by side.  A
    k-mer that all reads together hold no more than ``cutoff`` times is never
    counted that often before it comes; so those are found first, side by side
    and in blocks, and the ordered passes are given, and hold, only the others.
    Reads shorter than k pass.
    """
    ship_package(reads)
    name = F.col(sample).cast("string") if sample in reads.columns else F.lit("")
    rows = reads.select(F.coalesce(name, F.lit("")).alias("__sample"), F.col("seq_no").cast("long").alias("seq_no"), "sequence")

    def frequent(seen: Placed) -> pa.RecordBatch:
        n, often = seen.per_read(), seen.counts > cutoff
        ends = np.cumsum(seen.per_read(often))
        keys = [encoded_sorted(np.sort(x)) for x in np.split(seen.keys[often], ends[:-1])]
        return pa.RecordBatch.from_arrays([pa.array(seen.names, pa.string()), pa.array(seen.seq_no), pa.array(n), pa.array(keys, pa.binary())], names=["__sample", "seq_no", "n", "keys"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer((t or "").encode(), np.uint8) for t in batch.column("sequence").to_pylist()]
            keys = [np.sort(sequence_hashes(t, k)[0]) for t in texts]
            columns = [batch.column("__sample"), batch.column("seq_no"), pa.array([len(x) for x in keys], pa.int64()), pa.array([encoded_sorted(x) for x in keys], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["__sample", "seq_no", "n", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = object(), _Counts()
        for batch in batches:
            passed = []
            for name, n, data in zip(*(batch.column(c).to_pylist() for c in ("__sample", "n", "keys")), strict=True):
                if name != at:
                    at, counts = name, _Counts()
                keys = decoded_sorted(data).view(np.int64)
                ok = n == 0 or counts.at_least(keys, cutoff) < int(0.5 + n / 2)
                if ok and len(keys):
                    counts.add(keys)
                passed.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column("__sample"), batch.column("seq_no"), batch.column("n"), pa.array(passed, pa.bool_())], names=["sample", "seq_no", "n_kmers", "passed"])

    schema = "__sample string, seq_no long, n long, keys binary"
    rows = placed_counts(rows, k, frequent, schema, named="__sample") if k <= PACKED_K else rows.mapInArrow(hashed, schema)
    rows = rows.repartition("__sample").sortWithinPartitions("__sample", "seq_no")
    return rows.mapInArrow(run, "sample string, seq_no long, n_kmers long, passed boolean")


def filter_metrics(verdicts: DataFrame, interval: int) -> DataFrame:
    """(sample, tick, seq_t, t, n_seqs_passed, p_seqs_passed) at the end of every ``interval`` k-mers of a filter's run.

    verdicts: (sample, seq_no, n_kmers, passed).  Running sums by sample; ticks keep the remainder.
    """
    order = Window.partitionBy("sample").orderBy("seq_no").rowsBetween(Window.unboundedPreceding, 0)
    run = verdicts.select(
        "sample", "seq_no", F.sum("n_kmers").over(order).alias("t"), F.count("*").over(order).alias("seq_t"), F.sum(F.col("passed").cast("long")).over(order).alias("n_seqs_passed")
    ).withColumn("tick", F.floor(F.col("t") / interval))
    last = run.groupBy("sample", "tick").agg(F.max(F.struct("seq_no", "t", "seq_t", "n_seqs_passed")).alias("x")).where("tick > 0")
    return last.select("sample", "tick", "x.seq_t", "x.t", "x.n_seqs_passed", (F.col("x.n_seqs_passed") / F.col("x.seq_t")).alias("p_seqs_passed"))
