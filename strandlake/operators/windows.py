"""Ordered analytics: minimizers, sliding statistics, cutoffs and interval ticks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.arrays import flat, slices, window_starts
from strandlake.functions.hashing import sequence_hashes, unsigned_text
from strandlake.tables import ship_package


def rolling_min(df: DataFrame, value: str, order: str, w: int, by: tuple[str, ...] = ()) -> DataFrame:
    """df with ``min_value`` and ``min_at`` of the last w rows; of equal values the earliest."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - w, 0)
    least = F.min(F.struct(F.col(value).alias("v"), F.col(order).alias("i"))).over(frame)
    return df.withColumn("__m", least).withColumn("min_value", F.col("__m.v")).withColumn("min_at", F.col("__m.i")).drop("__m")


def interior_minimizers(df: DataFrame, value: str, order: str, w: int, by: tuple[str, ...] = ()) -> DataFrame:
    """rolling_min of full windows only."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rolling_min(df, value, order, w, by).withColumn("__n", n).where(F.col("__n") >= w).drop("__n")


def sliding(df: DataFrame, value: str, order: str, w: int, func: str = "mean", by: tuple[str, ...] = (), time: str | None = None) -> Column:
    """A statistic of the last w values, null until there are w: mean, median, stddev (population), normalized_mean."""
    if w < 2:
        raise ValueError("a window has two values at least")
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - w, 0)
    v = F.col(value)
    if func == "mean":
        stat = F.avg(v).over(frame)
    elif func == "stddev":
        stat = F.stddev_pop(v).over(frame)
    elif func == "median":
        # percentiles take no frame; of w sorted values the middle one or two are averaged
        s = F.sort_array(F.collect_list(v).over(frame))
        stat = (F.get(s, F.lit((w - 1) // 2)) + F.get(s, F.lit(w // 2))) / 2
    elif func == "normalized_mean":
        t = F.col(time or order)
        stat = F.avg(v).over(frame) / (F.last(t).over(frame) - F.first(t).over(frame))
    else:
        raise ValueError(f"unknown function {func}")
    return F.when(F.count(v).over(frame) == w, stat)


def sliding_cutoff(df: DataFrame, value: str, order: str, w: int, cutoff: float, func: str = "mean", test: str = "all", above: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """df with ``stat`` and ``reached``: whether all (or the median) of the last w statistics pass the cutoff.

    above: similarities pass when larger, distances when smaller.
    """
    out = df.withColumn("stat", sliding(df, value, order, w, func, by))
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - w, 0)
    full = F.count("stat").over(frame) == w
    if test == "all":
        edge = (F.min if above else F.max)("stat").over(frame)
    else:
        s = F.sort_array(F.collect_list("stat").over(frame))
        edge = (F.get(s, F.lit((w - 1) // 2)) + F.get(s, F.lit(w // 2))) / 2
    passed = edge > cutoff if above else edge < cutoff
    return out.withColumn("reached", F.when(full, passed).otherwise(False))


def until_reached(df: DataFrame, order: str, reached: str = "reached", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows, of each group ``by``, up to the first that reached the cutoff: a limit that the data decide.

    The place of that row is one aggregation; nothing is sorted.
    """
    first = df.groupBy(*by).agg(F.min(F.when(F.col(reached), F.col(order))).alias("__first"))
    rows = df.join(first, list(by)) if by else df.crossJoin(F.broadcast(first))
    return rows.where(F.col("__first").isNull() | (F.col(order) <= F.col("__first"))).drop("__first")


def applied(df: DataFrame, value: str, order: str, w: int, function: Callable[[np.ndarray], np.ndarray], by: str) -> DataFrame:
    """df with ``stat``: any function of a matrix of sliding windows, a row each, null until there are w values; groups side by side."""
    if w < 2:
        raise ValueError("a window has two values at least")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        stat = np.full(len(rows), np.nan)
        if len(rows) >= w:
            stat[w - 1 :] = function(np.lib.stride_tricks.sliding_window_view(rows[value].to_numpy(float), w))
        return rows.assign(stat=pd.Series(stat, rows.index).astype(object).where(~np.isnan(stat), None))

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.groupBy(by).applyInPandas(run, f"{kinds}, stat double")


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of every ``width`` values in a row, of equal ones the first."""
    at, span = np.arange(len(values)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while span * 2 <= width:
        at = better(at[:-span], at[span:])
        span *= 2
    rest = width - span
    return better(at[: len(at) - rest], at[rest:]) if rest else at


def kmer_minimizers(reads: DataFrame, w: int, k: int, canonical: bool = False) -> DataFrame:
    """(seq_no, pos, h, kmer): the least-hashing of every w k-mers in a row, each place once; of equal hashes the earliest.

    Windows slide within the task that reads the sequences; nothing is shuffled.
    """
    ship_package(reads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = (-1, -1)
            for data, at, piece, offset in slices(*flat(batch.column("sequence")), w + k - 2):
                start, row = window_starts(at, w + k - 1)
                if not len(start):
                    continue
                fw, rc = sequence_hashes(data, k)
                h = np.minimum(fw, rc) if canonical else fw
                found = _least_places(h, w)[start]
                # places do not go back within a read, so repeats are neighbours, also where a long read is cut
                new = np.concatenate(([(piece[row[0]], found[0] - at[row[0]] + offset[row[0]]) != last], found[1:] != found[:-1]))
                found, row = found[new], row[new]
                if not len(found):
                    continue
                pos = found - at[row] + offset[row]
                last = (piece[row[-1]], pos[-1])
                text = np.ascontiguousarray(data[found[:, None] + np.arange(k)])
                texts = pa.StringArray.from_buffers(len(found), pa.py_buffer((np.arange(len(found) + 1) * k).astype(np.int32)), pa.py_buffer(text))
                yield pa.RecordBatch.from_arrays([batch.column("seq_no").take(pa.array(piece[row])), pa.array(pos), pa.array(h[found].view(np.int64)), texts], names=["seq_no", "pos", "h", "kmer"])

    rows = reads.select("seq_no", "sequence").mapInArrow(run, f"seq_no {dict(reads.dtypes)['seq_no']}, pos long, h long, kmer string")
    return rows.select("seq_no", "pos", unsigned_text(F.col("h")).alias("h"), "kmer")


def pairwise(df: DataFrame, value: str, order: str, f: Callable[[Column, Column], Column], by: tuple[str, ...] = (), step: int = 1) -> Column:
    """f of each row's value and that ``step`` rows before."""
    return f(F.lag(value, step).over(Window.partitionBy(*by).orderBy(order)), F.col(value))


def interval_ticks(df: DataFrame, order: str, size: str, interval: int, sample: str) -> DataFrame:
    """(sample, order, tick, t): rows at which a counter of ``size`` reaches the interval, which then begins at 0.

    The remainder is dropped, so a sample is one ordered pass; samples run side by side.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, held, total, tick = [], 0, 0, 0
        for at, n in zip(*(rows.sort_values(order)[c] for c in (order, size)), strict=True):
            held, total = held + n, total + n
            if held >= interval:
                tick, held = tick + 1, 0
                out.append((rows[sample].iloc[0], at, tick, total))
        return pd.DataFrame(out, columns=[sample, order, "tick", "t"])

    kinds = dict(df.dtypes)
    return df.select(sample, order, size).groupBy(sample).applyInPandas(run, f"{sample} {kinds[sample]}, {order} {kinds[order]}, tick long, t long")


def floor_ticks(df: DataFrame, order: str, size: str, interval: int, by: tuple[str, ...] = (), block: int = 4096) -> DataFrame:
    """df with ``t`` (running size) and ``tick`` = floor(t / interval): ticks that keep the remainder.

    Sums run within blocks of the (whole-numbered) order; only the blocks' totals are summed in one task.
    """
    keys = [*by, "__b"]
    rows = df.withColumn("__b", F.floor(F.col(order) / block))
    totals = rows.groupBy(*keys).agg(F.sum(size).alias("__n"))
    before = totals.withColumn("__before", F.sum("__n").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
    own = F.sum(size).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__own", own).join(before.drop("__n"), keys)
    return rows.withColumn("t", F.col("__own") + F.col("__before")).withColumn("tick", F.floor(F.col("t") / interval)).drop("__b", "__own", "__before")


def every_n(ticks: Iterable[int], n: int) -> list[int]:
    return [t for t in ticks if t % n == 0]


def fib_ticks(last: int) -> list[int]:
    """Ticks whose gaps are the Fibonacci numbers 1, 1, 2, 3, ..."""
    out, at, a, b = [], 0, 1, 1
    while at + a <= last:
        at += a
        out.append(at)
        a, b = b, a + b
    return out


def exp_ticks(last: int, rate: float = 0.08) -> list[int]:
    """Ticks whose gaps are floor((1 + rate) ** i)."""
    out, at, i = [], 0, 0
    while (gap := max(1, int((1 + rate) ** i))) + at <= last:
        at, i = at + gap, i + 1
        out.append(at)
    return out
