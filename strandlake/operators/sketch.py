"""Sketches of k-mer sets: bottom-n and scaled MinHash, and partition counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strandlake.arrays import flat, slices
from strandlake.blocks import Kernel, counted_hashes
from strandlake.functions.hashing import max_hash_for_scaled, unsigned_key
from strandlake.functions.md5 import window_md5
from strandlake.kmers import window_codes
from strandlake.tables import ship_package, stored

#: Hashes that a task holds for all groups together before it hands them on.
HELD = 1 << 22


def portable_hash(kmer: Column) -> Column:
    """A non-negative 60-bit hash that any engine with MD5 shares."""
    return F.conv(F.substring(F.md5(kmer.cast("binary")), 1, 15), 16, 10).cast("long")


def kmer_hashes(k: int, keep: tuple[str, ...] = (), most: int | None = None) -> Kernel:
    """Arrow kernel: reads -> (*keep, h), ``portable_hash`` of every k-mer of ACGT; with ``most`` only hashes up to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, at, piece, _ in slices(*flat(batch.column("sequence")), k - 1):
                _, start, row = window_codes(data, at, k)
                if not len(start):
                    continue
                h = window_md5(data, k)[start]
                if most is not None:
                    near = h <= most
                    h, row = h[near], row[near]
                rows = pa.array(piece[row])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in keep), pa.array(h)], names=[*keep, "h"])

    return run


def _task_bottom(n: int, by: str | None, key: str, weight: str | None, kind: pa.DataType | None):
    """Arrow kernel: the n least distinct hashes of each group of a task, with their counts.

    A hash that n lesser ones have displaced cannot come back, so the counts of
    those that stay are whole.  What many groups hold is handed on in parts: a
    hash of the n least is among those of each part that has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict = {}
        keys, counts, edges, size = [], [], np.zeros(0, np.uint64), 0

        def out() -> Iterator[pa.RecordBatch]:
            sizes = [len(x) for x in keys]
            columns = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(counts))]
            if by is not None:
                columns.insert(0, pa.array(list(places), kind).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))))
            yield pa.RecordBatch.from_arrays(columns, names=[*([by] if by is not None else []), "h", "n"])

        for batch in batches:
            h = batch.column(key)
            w = np.ones(len(h), np.int64) if weight is None else np.asarray(batch.column(weight)).astype(np.int64)
            own = batch.column(by).dictionary_encode("encode") if by is not None else None
            groups = [None] if own is None else own.dictionary.to_pylist()
            g = np.zeros(len(h), np.int64) if own is None else np.asarray(own.indices).astype(np.int64)
            if h.null_count:
                known = np.asarray(h.is_valid())
                w, g, h = w[known], g[known], h.drop_null()
            h = np.asarray(h).view(np.uint64)
            for name in groups:
                if name not in places:
                    places[name] = len(places)
                    keys.append(np.zeros(0, np.uint64))
                    counts.append(np.zeros(0, np.int64))
            edges = np.concatenate((edges, np.full(len(keys) - len(edges), np.uint64((1 << 64) - 1))))
            g = np.array([places[name] for name in groups], np.int64)[g]
            near = h <= edges[g]
            h, g, w = h[near], g[near], w[near]
            order = np.lexsort((h, g))
            h, g, w = h[order], g[order], w[order]
            begin = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
            for lo, hi in zip(begin, np.append(begin, len(g))[1:], strict=True):
                i = g[lo]
                every, place = np.unique(np.concatenate((keys[i], h[lo:hi])), return_inverse=True)
                total = np.zeros(len(every), np.int64)
                np.add.at(total, place, np.concatenate((counts[i], w[lo:hi])))
                size += min(len(every), n) - len(keys[i])
                keys[i], counts[i] = every[:n], total[:n]
                if len(every) >= n:
                    edges[i] = keys[i][-1]
            if size > HELD and by is not None:
                yield from out()
                places, keys, counts, edges, size = {}, [], [], np.zeros(0, np.uint64), 0
        if keys:
            yield from out()

    return run


def bottom(hashes: DataFrame, n: int, by: str | None = None, key: str = "h", weight: str | None = None, made: Kernel | None = None) -> DataFrame:
    """The n least distinct hashes (unsigned), of each group ``by`` if given, with their ``abundance``.

    Each task gives its own n least, and only those are shuffled.  made: an Arrow
    kernel that makes the hashes, and keeps ``by``, from rows of another kind, run in the same task.
    """
    ship_package(hashes)
    order = unsigned_key(F.col(key))
    kinds = dict(hashes.dtypes)
    names = [*([by] if by else []), *([] if made else [key, *([weight] if weight else [])])]
    rows = hashes if made else hashes.where(F.col(key).isNotNull()).select(*names)
    kind = pa.schema(to_arrow_schema(hashes.select(by).schema)).field(0).type if by else None
    least = _task_bottom(n, by, key, weight, kind)
    rows = rows.mapInArrow((lambda batches: least(made(batches))) if made else least, f"{f'`{by}` {kinds[by]}, ' if by else ''}h long, n long")
    rows = rows.groupBy(*([by] if by else []), F.col("h").alias(key)).agg(F.sum("n").alias("abundance"))
    if by is None:
        return rows.orderBy(order).limit(n)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def _edge(scale: int) -> Column:
    """The largest hash of a scaled sketch, as a signed long."""
    top = max_hash_for_scaled(scale)
    return F.lit(top if top < 1 << 63 else top - (1 << 64))


def scaled(hashes: DataFrame, scale: int, by: str | None = None, key: str = "h") -> DataFrame:
    """Distinct hashes up to 2**64 / scale, with their abundance."""
    kept = hashes if scale == 0 else hashes.where(unsigned_key(F.col(key)) <= unsigned_key(_edge(scale)))
    return kept.groupBy(*([by] if by else []), key).agg(F.count("*").alias("abundance"))


def merged(a: DataFrame, b: DataFrame, n: int, key: str = "h") -> DataFrame:
    both = a.unionByName(b).groupBy(key).agg(F.sum("abundance").alias("abundance"))
    return both.orderBy(unsigned_key(F.col(key))).limit(n)


def removed(sketch: DataFrame, hashes: DataFrame, key: str = "h") -> DataFrame:
    return sketch.join(hashes.select(key).distinct(), key, "left_anti")


def similarity(sketches: DataFrame, by: str, key: str = "h") -> DataFrame:
    """(a, b, common, n_a, n_b, jaccard) of all groups that share a hash, a < b.

    Groups with the same hashes form a class, and classes are paired, joined on
    hashes: copies do not multiply a frequent hash's pairs, and groups with
    nothing in common are never paired.
    """
    sets = sketches.groupBy(by).agg(F.array_sort(F.collect_set(key)).alias("__s"))
    own = stored(sets.select(by, F.size("__s").cast("long").alias("n"), F.xxhash64("__s").alias("__a"), F.sha1(F.concat_ws(",", F.transform("__s", lambda x: x.cast("string"))).cast("binary")).alias("__d"), "__s"), "sketches")
    classes = own.groupBy("__a", "__d").agg(F.min(by).alias("rep"), F.first("n").alias("n"), F.first("__s").alias("__s"))
    classes = stored(classes, "classes")
    members = own.select(by, "__a", "__d").join(classes.select("__a", "__d", "rep", "n"), ["__a", "__d"]).select(by, "rep", "n")
    rows = classes.select("rep", F.explode("__s").alias(key))
    x, y = rows.select(F.col("rep").alias("x"), key), rows.select(F.col("rep").alias("y"), key)
    common = x.join(y, key).where("x < y").groupBy("x", "y").agg(F.count("*").alias("common"))
    # pairs of classes, either way round, and of each class with itself
    whole = classes.select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.col("n").alias("common"))
    pairs = common.unionByName(common.select(F.col("y").alias("x"), F.col("x").alias("y"), "common")).unionByName(whole)
    m = lambda side, other: members.select(F.col(by).alias(other), F.col("rep").alias(side), F.col("n").alias(f"n_{other}"))
    out = pairs.join(m("x", "a"), "x").join(m("y", "b"), "y").where("a < b")
    return out.select("a", "b", "common", "n_a", "n_b", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("jaccard"))


def class_similarity(sketches: DataFrame, by: str, key: str = "h") -> tuple[DataFrame, DataFrame]:
    """As ``similarity``, in two tables that do not grow with the square of a group of copies:
    (by, rep) of all groups, and (a, b, common, n_a, n_b, jaccard) of their representatives."""
    sets = sketches.groupBy(by).agg(F.array_sort(F.collect_set(key)).alias("__s"))
    reps = stored(sets.select(by, F.min(by).over(Window.partitionBy("__s")).alias("rep"), "__s"), "classes")
    rows = reps.where(F.col(by) == F.col("rep")).select("rep", F.explode("__s").alias(key))
    return reps.select(by, "rep"), similarity(rows, "rep", key)


def downsampled(sketch: DataFrame, scale: int, key: str = "h") -> DataFrame:
    """A scaled sketch with the lower bound of a larger scale."""
    return sketch.where(unsigned_key(F.col(key)) <= unsigned_key(_edge(scale)))


def compare(a: DataFrame, b: DataFrame, key: str = "h", num: int = 0) -> DataFrame:
    """One row: common, n_a, n_b, jaccard, containment of a in b, angular similarity of abundances.

    With ``num`` (sketches of the num least hashes) the union is cut to its num least, as such sketches demand.
    """
    x = a.select(key, F.col("abundance").alias("x"))
    y = b.select(key, F.col("abundance").alias("y"))
    both = x.join(y, key, "full")
    if num:
        both = both.orderBy(unsigned_key(F.col(key))).limit(num)
    shared = F.col("x").isNotNull() & F.col("y").isNotNull()
    dot = F.sum(F.when(shared, F.col("x") * F.col("y")).otherwise(0)).cast("double")
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)).cast("double"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (norm("x") * norm("y"))))
    return both.agg(
        F.count_if(shared).alias("common"), F.count("x").alias("n_a"), F.count("y").alias("n_b"), (F.count_if(shared) / F.count("*")).alias("jaccard"),
        (F.count_if(shared) / F.count("x")).alias("containment"), (1 - 2 * F.acos(cosine) / F.pi()).alias("angular"),
    )


def compared(sketches: DataFrame, by: str, num: int, key: str = "h", most: int = 1000) -> DataFrame:
    """(a, b, common, jaccard) of all pairs of a stated set of at most ``most`` bottom-``num`` sketches, over the num least hashes of both."""
    names = stored(sketches.select(by).distinct().limit(most + 1), "names")
    if names.count() > most:
        raise ValueError(f"{most} sketches at most are compared with one another")
    x, y = names.select(F.col(by).alias("a")), names.select(F.col(by).alias("b"))
    pairs = x.join(F.broadcast(y), F.col("a") < F.col("b"))
    side = lambda c, n: pairs.join(sketches.select(F.col(by).alias(c), key), c).select("a", "b", key, F.lit(n).alias("n"))
    rows = side("a", 1).unionByName(side("b", 2)).groupBy("a", "b", key).agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(unsigned_key(F.col(key))))
    rows = rows.withColumn("__r", rank).where(F.col("__r") <= num)
    return rows.groupBy("a", "b").agg(F.count_if(F.col("n") == 3).alias("common"), (F.count_if(F.col("n") == 3) / F.count("*")).alias("jaccard"))


def intersection(a: DataFrame, b: DataFrame, key: str = "h") -> DataFrame:
    return a.select(key).join(b.select(key), key, "left_semi").distinct()


def prefix_similarities(kmers: DataFrame, tick: str, n: int, key: str = "h", made: Kernel | None = None) -> DataFrame:
    """(tick, size, common, similarity): the bottom-n sketch of everything up to a tick against the tick before.

    What a prefix holds of its n least is among the n least of one of its ticks,
    so only those, n a tick at most, leave their tasks; one pass over them in
    order of ticks, one running sketch of n hashes, does the rest.  Ticks without
    hashes count too.  made: an Arrow kernel that makes the hashes, as for ``bottom``.
    """
    least = bottom(kmers, n, tick, key, made=made)
    news = least.groupBy(F.col(tick).cast("long").alias("first")).agg(F.collect_list(key).alias("h"))
    ticks = kmers.select(F.col(tick).cast("long").alias("first")).distinct().join(news, "first", "left") if made is None else news

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = []
            for at, h in zip(batch.column("first").to_pylist(), batch.column("h").to_pylist(), strict=True):
                own = np.array(h or [], np.int64).view(np.uint64)
                after = np.unique(own if held is None else np.concatenate((held, own)))[:n]
                if held is not None:
                    common = len(np.intersect1d(held, after))
                    rows.append((at, len(after), common, common / len(after) if len(after) else None))
                held = after
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=[tick, "size", "common", "similarity"])

    # n hashes a tick: the one ordered task reads ticks, not k-mers
    return ticks.repartition(1).sortWithinPartitions("first").mapInArrow(run, f"`{tick}` long, size int, common int, similarity double")


def partition_sketch(wmers: DataFrame, n_partitions: int, by: str, key: str = "h", partition: str = "partition") -> DataFrame:
    """(by, sketch): dense array of distinct w-mers per minimizer partition."""
    return _dense_sketch(wmers.groupBy(by, partition).agg(F.countDistinct(key).alias("n")), n_partitions, by, partition)


def partition_sketch_of(reads: DataFrame, wmers: Kernel, n_partitions: int, by: str) -> DataFrame:
    """As ``partition_sketch``, of reads that carry ``by`` and the kernel of their w-mers: distinct ones are found in blocks."""
    return _dense_sketch(counted_hashes(reads, wmers, by).groupBy(by, "partition").agg(F.count("*").alias("n")), n_partitions, by, "partition")


def _dense_sketch(counts: DataFrame, n_partitions: int, by: str, partition: str) -> DataFrame:
    found = counts.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(partition, "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n_partitions - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i.cast("long")), F.lit(0).cast("long")))
    return found.select(by, dense.alias("sketch"))


def reservoir(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, each as likely as any other: those of the least hashes of key and seed, so a rerun takes the same."""
    mixed = portable_hash(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(mixed, key).limit(n)


def counted(sketch: DataFrame, store: DataFrame, key: str = "h") -> DataFrame:
    """A sketch whose abundances are the counts of a store, 0 where it has none."""
    own = store.select(key, F.col("count").alias("__n"))
    return sketch.join(own, key, "left").withColumn("abundance", F.coalesce("__n", F.lit(0)).cast("long")).drop("__n")
