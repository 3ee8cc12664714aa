"""Operator 1: document quality by a regularised quadratic discriminant.

Transformed statistics of whole texts are Gaussian within each class.  The class
covariances are shrunk towards the pooled one and that towards its diagonal; a
score is the difference of Mahalanobis log densities, from Cholesky factors that
are computed once, squeezed to 0..1 with a temperature and the class odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import text_kernels as tk
from strandlake.llm.scratch import ship_package

#: Labelled rows that the classifier is fitted on, at most.
TRAIN_ROWS = 20_000
#: Share of the pooled covariance in a class's, and of the diagonal in the pooled one.
SHRINK_TO_POOLED = 0.3
SHRINK_TO_DIAGONAL = 0.2
#: Score from which a document counts as good.
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "exclaims", "bars", "sentence_ends", "commas", "non_ascii",
    "repeated_lines", "distinct_words", "words_a_line", "symbol_words", "repeated_words", "longest_word",
)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text (null: as empty)."""
    data, at = tk.flat_bytes(column)
    n_docs = len(at) - 1
    words = tk.Words(data, at, lower=True)
    n_words = np.diff(words.at).astype(float)

    def per_doc(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return (sums[at[1:]] - sums[at[:-1]]).astype(float)

    n_bytes = np.diff(at).astype(float)
    chars = np.maximum(per_doc((data & 0xC0) != 0x80), 1)
    count = np.maximum(n_words, 1)
    wide_upper = np.zeros(len(data), bool)
    wide_upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F)
    upper = per_doc(((data >= 65) & (data <= 90)) | wide_upper)
    is_symbol = np.isin(data, np.frombuffer(b"#*$%&<>{}[]=+~^\\/_@", np.uint8))
    lines = per_doc(data == 10) + 1
    # lines as spans of words: a line's hash sums its words' hashes by place
    in_doc = np.repeat(np.arange(n_docs), np.diff(words.at))
    breaks = np.concatenate(([0], np.cumsum(data == 10)))[words.start] if len(words.start) else np.zeros(0, np.int64)
    repeated = np.zeros(n_docs)
    distinct = np.ones(n_docs)
    doubled = np.zeros(n_docs)
    longest = np.zeros(n_docs)
    if len(words.start):
        new = np.ones(len(breaks), bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (in_doc[1:] != in_doc[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(breaks)))
        place = tk.ranges(np.zeros(len(first), np.int64), size).astype(np.uint64)
        line = tk.mix64(np.add.reduceat(tk.mix64(words.hash + place), first))
        line_doc = in_doc[first]
        order = np.lexsort((line, line_doc))
        same = (line[order][1:] == line[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
        np.add.at(repeated, line_doc[order][1:][same], size[order][1:][same].astype(float))
        order = np.lexsort((words.hash, in_doc))
        other = np.ones(len(order), bool)
        other[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (in_doc[order][1:] != in_doc[order][:-1])
        distinct = np.maximum(np.bincount(in_doc[order][other], minlength=n_docs), 1).astype(float)
        twice = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (in_doc[1:] == in_doc[:-1]))
        np.add.at(doubled, in_doc[twice], 1.0)
        some = np.flatnonzero(n_words)
        longest[some] = np.maximum.reduceat(words.end - words.start, words.at[:-1][some])
        ends = words.end - 1
        sums = np.concatenate(([0], np.cumsum(is_symbol[ends])))
        symbol_words = (sums[words.at[1:]] - sums[words.at[:-1]]).astype(float)
    else:
        symbol_words = np.zeros(n_docs)
    root = lambda x, of: np.sqrt(x / of)
    return np.stack(
        [
            np.log1p(n_words),
            np.log1p(n_bytes / count),
            root(upper, chars),
            root(per_doc((data >= 48) & (data <= 57)), chars),
            root(per_doc(is_symbol), chars),
            root(per_doc(data == 33), chars),
            root(per_doc(data == 124), chars),
            root(per_doc(data == 46), count),
            root(per_doc(data == 44), count),
            root(per_doc(data >= 0xC0), chars),
            root(repeated, count),
            np.log(distinct) / np.log(np.maximum(n_words, 2)),
            np.log1p(n_words / lines),
            root(symbol_words, count),
            root(doubled, count),
            np.log1p(longest),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Discriminant:
    """Means, scale and, per class, the inverse Cholesky factor and log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    log_dets: tuple[float, float]
    log_odds: float
    temperature: float

    @classmethod
    def fit(cls, x: np.ndarray, label: np.ndarray) -> Discriminant:
        """From feature rows and labels 0 or 1; a class without rows takes the pooled shape."""
        d = x.shape[1] if x.ndim == 2 and len(x) else len(FEATURES)
        x = x.reshape(-1, d)
        centre = x.mean(axis=0) if len(x) else np.zeros(d)
        scale = x.std(axis=0) if len(x) else np.ones(d)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = (x - centre) / scale
        groups = [z[label == k] for k in (0, 1)]
        means = tuple(g.mean(axis=0) if len(g) else np.zeros(d) for g in groups)
        scatter = sum((g - m).T @ (g - m) for g, m in zip(groups, means, strict=True))
        pooled = scatter / max(len(z) - 2, 1)
        pooled = (1 - SHRINK_TO_DIAGONAL) * pooled + SHRINK_TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-3 * np.eye(d)
        factors, log_dets = [], []
        for g, m in zip(groups, means, strict=True):
            own = (g - m).T @ (g - m) / max(len(g) - 1, 1)
            share = 1.0 if len(g) < 2 else SHRINK_TO_POOLED
            lower = np.linalg.cholesky((1 - share) * own + share * pooled)
            factors.append(np.linalg.inv(lower))
            log_dets.append(2 * float(np.log(np.diag(lower)).sum()))
        odds = float(np.log((len(groups[1]) + 1) / (len(groups[0]) + 1)))
        plain = cls(centre, scale, means, tuple(factors), tuple(log_dets), odds, 1.0)
        return plain if min(map(len, groups)) == 0 else cls(centre, scale, means, tuple(factors), tuple(log_dets), odds, plain._best_temperature(x, label))

    def _best_temperature(self, x: np.ndarray, label: np.ndarray) -> float:
        """The divisor of log densities that makes the training scores most likely (features are not independent)."""
        gap = self.density_gap(x)
        sign = np.where(label == 1, 1.0, -1.0)
        grid = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0)
        return min(grid, key=lambda t: float(np.logaddexp(0, -sign * (gap / t + self.log_odds)).sum()))

    def density_gap(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0."""
        z = (x - self.centre) / self.scale
        logs = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.density_gap(x) / self.temperature + self.log_odds, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch):
            x = statistics(part.column("text"))
            flat = pa.array(x.reshape(-1))
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, x.shape[1], dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([part.column("quality"), lists], names=["quality", "features"])


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Discriminant:
    """Fit on at most ``limit`` labelled documents, chosen by a hash of their id; held-out ones are left out.

    Labels other than 0 and 1, null ids and labels without a document count for
    nothing.  Of several labels of one id the least counts, of several documents
    of one id the least text, so the fit does not depend on the order of rows.
    Empty tables give a model that scores everything by equal odds.
    """
    ship_package(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = rows.select("quality", "text").mapInArrow(_features, "quality int, features array<double>")
    got = rows.toPandas()  # at most ``limit`` rows
    x = np.array(got["features"].tolist(), float).reshape(-1, len(FEATURES))
    label = got["quality"].to_numpy(int)
    order = np.lexsort((*x.T, label))  # the fit does not depend on the order of rows
    return Discriminant.fit(x[order], label[order])


def _score(shared, threshold: float, keep: list[str] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in tk.slices(batch):
                score = model.score(statistics(part.column("text")))
                good = pa.array((score >= threshold).astype(np.int32))
                names = keep or part.schema.names
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(score), good], names=[*names, "score", "predicted"])

    return run


def score_quality(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Only texts are looked at.  Null texts score as empty ones; null doc_ids and
    repeated rows pass through; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_score(shared, threshold, ["doc_id"]), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_low_quality(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text is predicted good, with all their columns, in their order.

    Only texts are looked at: null ones score as empty ones; null ids, repeated
    rows and ties are rows like others; an empty table gives no rows.  Columns may
    have any names, ``score`` and ``predicted`` too.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([*rows.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    scored = rows.mapInArrow(_score(shared, threshold), schema)
    return scored.where("predicted = 1").select("row.*")
