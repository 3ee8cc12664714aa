"""Distances of vectors and similarities of sets, as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def cosine(a: Column, b: Column) -> Column:
    a, b = _doubles(a), _doubles(b)
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    return 1 - _sum(_zip(a, b, lambda x, y: x * y)) / (norm(a) * norm(b))


def correlation(a: Column, b: Column) -> Column:
    centre = lambda v: F.transform(F.array(_sum(v) / F.size(v)), lambda m: F.transform(v, lambda x: x - m))[0]
    return cosine(centre(_doubles(a)), centre(_doubles(b)))


def sqeuclidean(a: Column, b: Column) -> Column:
    return _sum(_zip(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sqeuclidean(a, b))


def cityblock(a: Column, b: Column) -> Column:
    return _sum(_zip(_doubles(a), _doubles(b), lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(_zip(_doubles(a), _doubles(b), lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: float = 2.0) -> Column:
    return F.pow(_sum(_zip(_doubles(a), _doubles(b), lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1 / p))


def canberra(a: Column, b: Column) -> Column:
    term = lambda x, y: F.when(F.abs(x) + F.abs(y) == 0, 0.0).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y)))
    return _sum(_zip(_doubles(a), _doubles(b), term))


def braycurtis(a: Column, b: Column) -> Column:
    a, b = _doubles(a), _doubles(b)
    return _sum(_zip(a, b, lambda x, y: F.abs(x - y))) / _sum(_zip(a, b, lambda x, y: F.abs(x + y)))


def jensenshannon(a: Column, b: Column) -> Column:
    """Of non-negative vectors, which are normalised."""
    share = lambda v: F.transform(F.array(_sum(v)), lambda t: F.transform(v, lambda x: x / t))[0]
    p, q = share(_doubles(a)), share(_doubles(b))
    part = lambda x, m: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    return F.sqrt(F.greatest(_sum(_zip(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))) / 2, F.lit(0.0)))


def seuclidean(a: Column, b: Column, variances: Column) -> Column:
    squares = _zip(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(_sum(_zip(squares, _doubles(variances), lambda d, v: d / v)))


def mahalanobis(a: Column, b: Column, inverse_covariance: Column) -> Column:
    """inverse_covariance: array of rows."""
    d = _zip(_doubles(a), _doubles(b), lambda x, y: x - y)
    rows = F.transform(F.array(d), lambda v: F.transform(inverse_covariance, lambda r: _sum(F.zip_with(_doubles(r), v, lambda x, y: x * y))))[0]
    return F.sqrt(_sum(_zip(rows, d, lambda x, y: x * y)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets: 1 for the same."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(a)


def angular(a: Column, b: Column) -> Column:
    """1 - 2 angle / pi of two abundance vectors."""
    return 1 - 2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - cosine(a, b)))) / F.pi()


METRICS = {
    f.__name__: f
    for f in (cosine, correlation, sqeuclidean, euclidean, cityblock, chebyshev, minkowski, canberra, braycurtis, jensenshannon, seuclidean, mahalanobis, jaccard, containment, angular)
}


def distance(a: Column, b: Column, metric: str, *args) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    return METRICS[metric](a, b, *args)


def rolling_distances(df: DataFrame, vector: str, order: str, sizes: Sequence[int] = (2, 4, 6, 8, 10), metrics: Sequence[str] = ("cosine",), by: Sequence[str] = ()) -> DataFrame:
    """(*by, order, freq, metric, distance, time_norm): each row against the one freq - 1 rows before it.

    Every window of each size counts, those at the tail too; time_norm is the
    order's share of its largest value.  Rows are numbered by group, and a row
    meets its predecessors in a join on numbers, so vectors of one series spread.
    """
    numbers = df.select(*by, order).withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    numbered = df.select(*by, order, vector).join(numbers, [*by, order])
    last = df.groupBy(*by).agg(F.max(order).alias("__last"))
    keys = [*by, "__n"]
    ahead = numbered.select(*by, F.col(vector).alias("__v"), F.explode(F.array(*[F.struct(F.lit(n).alias("freq"), (F.col("__n") + n - 1).alias("__n")) for n in sizes])).alias("x"))
    rows = numbered.join(ahead.select(*by, "__v", "x.freq", "x.__n"), keys)
    rows = rows.join(last, list(by)) if by else rows.crossJoin(F.broadcast(last))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), distance(F.col("__v"), F.col(vector), m).alias("distance")) for m in metrics]))
    return rows.select(*by, order, "freq", each.alias("x"), (F.col(order) / F.col("__last")).alias("time_norm")).select(*by, order, "freq", "x.metric", "x.distance", "time_norm").where("distance is not null")


def distance_matrix(df: DataFrame, key: str, vector: str, metric: str = "cosine", most: int = 10_000) -> DataFrame:
    """(a, b, distance) of all pairs a < b of a stated set of at most ``most`` vectors; more are an error."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a distance matrix has {most} rows at most")
    x = df.select(F.col(key).alias("a"), F.col(vector).alias("__x"))
    y = df.select(F.col(key).alias("b"), F.col(vector).alias("__y"))
    return x.join(F.broadcast(y), F.col("a") < F.col("b")).select("a", "b", distance(F.col("__x"), F.col("__y"), metric).alias("distance"))


def distances_from(df: DataFrame, vector: str, reference: Sequence[float], metric: str = "cosine") -> DataFrame:
    """df with ``distance`` from one reference vector, which is part of the plan."""
    return df.withColumn("distance", distance(F.array(*map(F.lit, reference)), F.col(vector), metric))
