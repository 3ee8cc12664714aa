"""Saturation of a growing sketch: how like it is to itself an interval ago, smoothed, until a cutoff is reached.

Intervals are ticks of a fixed number of k-mers over reads in order.  Everything
is computed for all ticks at once; the stop is a filter on what was computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import distances
from strandlake.functions.murmur import murmur_kmers
from strandlake.operators import hitting, sketch, windows
from strandlake.tables import stored


def ticked(reads: DataFrame, k: int, interval: int) -> DataFrame:
    """reads with ``t`` (k-mers up to and with this read) and ``tick``, the interval that it belongs to."""
    rows = reads.withColumn("__n", F.greatest(F.length("sequence") - k + 1, F.lit(0)).cast("long"))
    rows = windows.floor_ticks(rows, "seq_no", "__n", interval)
    # a read belongs to the interval in which it begins
    return rows.withColumn("tick", F.floor((F.col("t") - F.col("__n")) / interval)).drop("__n")


def tick_ends(rows: DataFrame) -> DataFrame:
    """(tick, t, sequence): k-mers and reads consumed at the end of each interval."""
    return rows.groupBy("tick").agg(F.max("t").alias("t"), F.max("seq_no").alias("sequence"))


def minhash_curve(rows: DataFrame, k: int, n: int) -> DataFrame:
    """(tick, distance) of ticked reads: similarity of the bottom-n sketch to that of the tick before."""
    hashes = murmur_kmers(rows, k, keep=("tick", "seq_no")).select("tick", "h")
    return sketch.prefix_similarities(hashes, "tick", n).select("tick", F.col("similarity").alias("distance"))


def partition_curve(rows: DataFrame, w: int, k: int, hits: DataFrame, metric: str = "cosine") -> DataFrame:
    """(tick, distance) of ticked reads: distance of the partition sketch from that of the tick before.

    A w-mer counts from its first tick on, so each tick adds its new ones to running sums by partition.
    """
    wmer = hitting.wmers(rows, w, k, hits, keep=("tick", "seq_no")).where("partition is not null")
    news = wmer.groupBy("partition", "h").agg(F.min("tick").alias("tick")).groupBy("tick", "partition").agg(F.count("*").alias("n"))
    ticks = rows.select("tick").distinct()
    every = ticks.join(F.broadcast(hits.select("partition").distinct())).join(news, ["tick", "partition"], "left")
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("partition").orderBy("tick"))
    vectors = every.select("tick", "partition", total.alias("n")).groupBy("tick").agg(F.transform(F.array_sort(F.collect_list(F.struct("partition", "n"))), lambda x: x["n"]).alias("v"))
    return distances.rolling_distances(vectors, "v", "tick", (2,), (metric,)).select("tick", "distance")


def decided(curve: DataFrame, window: int = 5, cutoff: float = 0.999, func: str = "mean", test: str = "all", above: bool = True) -> DataFrame:
    """curve with ``stat`` (of the last ``window`` distances) and ``reached``: whether the last ``window`` stats pass the cutoff."""
    return windows.sliding_cutoff(curve, "distance", "tick", window, cutoff, func, test, above)


def saturated(rows: DataFrame, curve: DataFrame) -> DataFrame:
    """The ticked reads up to the end of the first tick that reached the cutoff; all where none did."""
    first = stored(curve.where("reached").agg(F.min("tick").alias("__stop")), "stop")
    return rows.crossJoin(F.broadcast(first)).where("__stop is null or tick <= __stop").drop("__stop")
