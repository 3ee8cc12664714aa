"""Structured Streaming: saturation of sketches, event-time windows and first sightings."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.functions.murmur import murmur_kmers
from strandlake.kmers import PACKED_K, kmers, packed_kmers
from strandlake.operators.graph import Compacted, nodes
from strandlake.operators.sketch import bottom
from strandlake.streaming.messages import DistanceCalc, EndStream, Error, Gauge, Handlers, Interval, SampleFinished, SampleSaturated, SampleStarted

READY, RUNNING, INTERRUPTED, STOP_SATURATED, STOP_ERROR, STOP = "READY", "RUNNING", "SIGINT", "STOP_SATURATED", "STOP_ERROR", "STOP"
_TOP = 1 << 64
SMOOTHING = {"mean": statistics.fmean, "median": statistics.median, "stddev": statistics.pstdev}


class SaturationStream:
    """A bottom-n sketch of a stream of reads, which stops once it no longer changes.

    Each micro-batch is an interval.  Its own bottom-n sketch, n rows at most, is
    what the driver merges into the running sketch; the similarity to the sketch
    before is smoothed over ``window`` intervals, and the stream is saturated when
    all of the last ``window`` means pass ``cutoff``.
    """

    def __init__(self, k: int = 31, n: int = 2500, cutoff: float = 0.999, window: int = 5, sample: str = "sample", handlers: Handlers | None = None, smooth: str = "mean", test: str = "all", save_every: int = 0):
        if window < 2:
            raise ValueError("a window has two values at least")
        self.k, self.n, self.cutoff, self.window, self.sample = k, n, cutoff, window, sample
        self.smooth, self.decide = SMOOTHING[smooth], {"all": min, "median": statistics.median}[test]
        self.save_every, self.saved = save_every, []
        self.handlers = handlers or Handlers()
        self.mins: dict[int, int] = {}
        self.distances: list[float] = []
        self.stats: list[float] = []
        self.t = self.sequences = 0
        self.state, self.last_batch = READY, -1

    def _at(self) -> dict:
        return {"sample_name": self.sample, "t": self.t, "sequence": self.sequences}

    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        """One interval; a batch that is replayed, or comes after saturation, changes nothing."""
        if batch_id <= self.last_batch or self.state == STOP_SATURATED:
            return
        if self.state == READY:
            self.state = RUNNING
            self.handlers.send(SampleStarted(**self._at()))
        began = time.monotonic()
        totals = batch.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.length("sequence") - self.k + 1, F.lit(0))), F.lit(0)).alias("t")).first()
        news = bottom(murmur_kmers(batch, self.k), self.n).collect()
        before = set(self.mins)
        for row in news:
            h = row["h"] % _TOP
            self.mins[h] = self.mins.get(h, 0) + row["abundance"]
        self.mins = {h: self.mins[h] for h in sorted(self.mins)[: self.n]}
        delta, self.last_batch = totals["t"], batch_id
        self.t, self.sequences = self.t + delta, self.sequences + totals["n"]
        self.handlers.send(Interval(**self._at(), seconds=time.monotonic() - began))
        if before:
            self._compare(before, delta)
        if self.save_every and len(self.distances) % self.save_every == 0:
            self.saved.append((self.t, dict(self.mins)))

    def _compare(self, before: set[int], delta: int) -> None:
        self.distances.append(len(before & set(self.mins)) / len(self.mins))
        stat = None
        if len(self.distances) >= self.window:
            stat = self.smooth(self.distances[-self.window :])
            self.stats.append(stat)
        self.handlers.send(DistanceCalc(**self._at(), delta=delta, distance=self.distances[-1], stat=stat))
        last = self.stats[-self.window :]
        if len(last) == self.window and self.decide(last) > self.cutoff:
            self.state = STOP_SATURATED
            self.handlers.send(SampleSaturated(**self._at()))

    def run(self, reads: DataFrame, checkpoint: str, poll: float = 0.2) -> str:
        """Consume a streaming DataFrame until it ends or is saturated; the final state.

        The sketch lives in the driver: a run that is begun again needs a new checkpoint.
        """
        running = reads.writeStream.foreachBatch(self.absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            while not running.awaitTermination(poll):
                if self.state == STOP_SATURATED:
                    running.stop()
        except KeyboardInterrupt:
            running.stop()
            self.state = INTERRUPTED
        except Exception as e:
            self.state = STOP_ERROR
            self.handlers.send(Error(**self._at(), error=str(e)))
            raise
        if self.state not in (STOP_SATURATED, INTERRUPTED):
            self.state = STOP
        self.handlers.send(SampleFinished(**self._at()))
        self.handlers.send(EndStream(**self._at()))
        return self.state


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream's watermark needs a timestamp with a time zone, the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 day", by: str = "event_type") -> DataFrame:
    """(window_start, by, n, total) of batch or streaming events in tumbling or sliding windows of event time."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = _timed(events, late)
    out = rows.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", by: str = "user_id") -> DataFrame:
    """(by, session_start, session_end, n) of events no further apart than ``gap``."""
    rows = _timed(events, late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_seen(rows: DataFrame, key: str = "kmer") -> DataFrame:
    """K-mers that the stream had not held before; the state grows with distinct k-mers and lives in the state store."""
    return rows.dropDuplicates([key])


class Inserter(Protocol):
    """What takes in reads: called with the reads of one interval and its number."""

    def insert(self, reads: DataFrame, interval: int) -> None: ...


class ReadFilter(Protocol):
    """What keeps some of an interval's reads."""

    def accept(self, reads: DataFrame) -> DataFrame: ...


def run_inserter(reads: DataFrame, inserter: Inserter, checkpoint: str, handlers: Handlers | None = None, sample: str = "sample") -> StreamingQuery:
    """Feed a stream to an inserter, a micro-batch an interval; messages tell how far it is."""
    handlers, at = handlers or Handlers(), {"sequence": 0, "t": 0}

    def write(batch: DataFrame, batch_id: int) -> None:
        began = time.monotonic()
        inserter.insert(batch, batch_id)
        totals = batch.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("t")).first()
        at["sequence"], at["t"] = at["sequence"] + totals["n"], at["t"] + totals["t"]
        handlers.send(Interval(sample_name=sample, t=at["t"], sequence=at["sequence"], seconds=time.monotonic() - began))

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class GraphStream:
    """A compacted graph that takes in a stream, interval after interval; only what new k-mers touch is compacted anew.

    gate: what of an interval's reads goes in (a filter by solid k-mers or by
    normalisation, say); callbacks get (graph, interval number) after each.
    """

    def __init__(self, k: int, canonical: bool = False, gate: Callable[[DataFrame], DataFrame] | None = None):
        self.k, self.canonical, self.gate = k, canonical, gate
        self.graph: Compacted | None = None
        self.callbacks: list[Callable[[Compacted, int], None]] = []
        self.last = -1

    def insert(self, reads: DataFrame, interval: int) -> None:
        if interval <= self.last:  # replayed
            return
        reads = reads if self.gate is None else self.gate(reads)
        node = nodes((packed_kmers if self.k <= PACKED_K else kmers)(reads, self.k))
        self.graph = Compacted(node, self.k, self.canonical) if self.graph is None else self.graph.updated(node)
        self.last = interval
        for callback in self.callbacks:
            callback(self.graph, interval)


def run_filter(reads: DataFrame, accept: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, passed: Gauge | None = None) -> StreamingQuery:
    """Write the reads that ``accept`` keeps of each micro-batch, a folder each; a replayed batch replaces its own.

    passed: a gauge that is raised by the number of reads that passed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/batch={batch_id}"
        accept(batch).write.mode("overwrite").parquet(target)
        if passed is not None:
            passed.add(batch.sparkSession.read.parquet(target).count())

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def json_sink(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream's rows as lines of JSON, written while it runs."""
    return rows.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
