"""Minimizer partitions of w-mers by a given k-mer set, and the tags between partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.arrays import flat, slices
from strandlake.kmers import pack, window_codes
from strandlake.operators.hitting import MOST, sliding_min
from strandlake.tables import Relay, ship_package


def hitting_set(rows: DataFrame, kmer: str = "kmer", order: str = "ord") -> DataFrame:
    """(kmer, partition): distinct k-mers numbered by first appearance."""
    first = rows.groupBy(F.col(kmer).alias("kmer")).agg(F.min(order).alias("o"))
    # the set is numbered in one task: it is a set of short k-mers, small whatever the reads
    return first.select("kmer", (F.row_number().over(Window.orderBy("o")) - 1).cast("long").alias("partition"))


def first_places(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, ord) of packed short k-mers (k up to 10): the first place (seq_no, pos) of each in some letters of the reads; ``hitting_set`` takes the first of those."""
    if not 1 <= k <= 10:
        raise ValueError("k must be from 1 to 10")
    ship_package(reads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, at, piece, offset in slices(*flat(batch.column("sequence")), k - 1):
                codes, start, row = window_codes(data, at, k)
                if not len(start):
                    continue
                own = batch.column("seq_no").take(pa.array(piece))
                order = np.asarray(pc.sort_indices(own)).astype(np.int64)
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                first = np.full(1 << 2 * k, np.iinfo(np.int64).max)
                np.minimum.at(first, pack(codes, k)[start], (rank[row] << 32) | (start - at[row] + offset[row]))
                hit = np.flatnonzero(first != np.iinfo(np.int64).max)
                place = first[hit]
                yield pa.RecordBatch.from_arrays([pa.array(hit), own.take(pa.array(order[place >> 32])), pa.array(place & 0xFFFFFFFF)], names=["kmer", "seq_no", "pos"])

    rows = reads.select("seq_no", "sequence").mapInArrow(run, f"kmer long, seq_no {dict(reads.dtypes)['seq_no']}, pos long")
    return rows.select("kmer", F.struct("seq_no", "pos").alias("ord"))


def tags_of_reads(reads: DataFrame, hits: DataFrame, w: int, k: int) -> DataFrame:
    """As ``tags`` of ``window_minimizers``, for a bounded set of packed k-mers that goes to all tasks: windows slide where reads are read."""
    ship_package(reads)
    listed = hits.select("kmer", "partition").limit(MOST + 1).collect()
    if len(listed) > MOST:
        raise ValueError("a hitting set that is sent to all tasks is bounded")
    pairs = sorted((r.kmer, r.partition) for r in listed)
    shared = reads.sparkSession.sparkContext.broadcast((np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = shared.value
        none = len(known)
        for batch in batches:
            # a tag is two w-mers, so a piece shares w symbols with the next
            for data, at, piece, offset in slices(*flat(batch.column("sequence")), w):
                codes, start, row = window_codes(data, at, w + 1)
                if not len(start) or not none:
                    continue
                keys = pack(codes, k)
                rank = np.searchsorted(known, keys)
                rank[known[np.minimum(rank, none - 1)] != keys] = none
                least = sliding_min(rank, w - k + 1)
                left, right = least[start], least[start + 1]
                tag = (left != right) & (left < none) & (right < none)
                tag[tag] = part[left[tag]] != part[right[tag]]
                start, row, left, right = start[tag], row[tag], left[tag], right[tag]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("seq_no").take(pa.array(piece[row])), pa.array(start - at[row] + offset[row]), pa.array(part[left]), pa.array(part[right])], names=["seq_no", "pos", "left_partition", "right_partition"]
                )

    return reads.select("seq_no", "sequence").mapInArrow(run, f"seq_no {dict(reads.dtypes)['seq_no']}, pos long, left_partition long, right_partition long")


def window_minimizers(kmers: DataFrame, hits: DataFrame, w: int, k: int) -> DataFrame:
    """(seq_no, pos, kmer, partition): for each w-mer start, the least k-mer of the set inside it.

    w-mers without one have none and are left out.
    """
    found = kmers.join(hits, "kmer", "left")
    least = F.min(F.when(F.col("partition").isNotNull(), F.struct("kmer", "partition")))
    frame = Window.partitionBy("seq_no").orderBy("pos").rowsBetween(0, w - k)
    full = F.count("*").over(frame) == w - k + 1
    rows = found.select("seq_no", "pos", least.over(frame).alias("m"), full.alias("full")).where("full and m is not null")
    return rows.select("seq_no", "pos", "m.kmer", "m.partition")


def tags(minimizers: DataFrame) -> DataFrame:
    """(seq_no, pos, left_partition, right_partition): neighbouring w-mers of different partitions."""
    step = Window.partitionBy("seq_no").orderBy("pos")
    rows = minimizers.withColumn("np", F.lead("pos").over(step)).withColumn("nq", F.lead("partition").over(step))
    return rows.where("np = pos + 1 and nq <> partition").select("seq_no", "pos", F.col("partition").alias("left_partition"), F.col("nq").alias("right_partition"))


def tag_links(tag: DataFrame) -> DataFrame:
    """(left_partition, right_partition, n_reads, n): links between partitions that the reads' tags make."""
    own = tag.groupBy("left_partition", "right_partition", "seq_no").agg(F.count("*").alias("n"))
    return own.groupBy("left_partition", "right_partition").agg(F.count("*").alias("n_reads"), F.sum("n").alias("n"))


def read_tags(tag: DataFrame) -> DataFrame:
    """(seq_no, path): the partitions a read goes through, tag after tag, in order."""
    steps = F.array_sort(F.collect_list(F.struct("pos", "left_partition", "right_partition")))
    return tag.groupBy("seq_no").agg(steps.alias("s")).select("seq_no", F.transform("s", lambda x: F.struct(x["left_partition"], x["right_partition"])).alias("path"))


def walks_to_tips(tag: DataFrame, tips: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, tip, end_state) of walks from tag to tag by their ``left`` until one is no tag.

    tag: (key, left), one a key; tips: (key).  STOP_FWD: a tip was reached;
    GRAPH_ERROR: what was reached is neither a tag nor a tip (tip is null then);
    STOP_SEEN: the walk goes round; BAD_SEED: the seed is no tag.  All walks jump
    at once, twice as far each round.
    """
    relay = Relay("tag-walks")
    keys = tag.select(F.col("key").alias("up"), F.lit(True).alias("__more"))
    state = tag.select("key", F.col("left").alias("up")).join(keys, "up", "left")
    state = relay.put(state.select("key", F.col("up").alias("end"), F.when(F.col("__more"), F.col("up")).alias("up")))
    rounds, n = 0, state.count()
    while (1 << rounds) <= n and state.where("up is not null").limit(1).count():
        far = state.select(F.col("key").alias("up"), F.col("end").alias("__e"), F.col("up").alias("__u"))
        state = relay.put(state.join(far, "up", "left").select("key", F.coalesce("__e", "end").alias("end"), F.col("__u").alias("up")))
        rounds += 1
    asked = seeds.select(F.col("key").alias("seed")).distinct().join(state.withColumnRenamed("key", "seed").withColumn("__known", F.lit(True)), "seed", "left")
    asked = asked.join(tips.select(F.col("key").alias("end"), F.lit(True).alias("__tip")).distinct(), "end", "left")
    open_ = F.col("up").isNotNull()
    found = F.when(F.col("__known").isNull(), "BAD_SEED").when(open_, "STOP_SEEN").when(F.col("__tip"), "STOP_FWD").otherwise("GRAPH_ERROR")
    return asked.select("seed", F.when(~open_ & F.col("__tip"), F.col("end")).alias("tip"), found.alias("end_state"))
