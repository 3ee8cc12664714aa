"""K-mer stores: exact sets and counts, and the probabilistic ones by their bins.

A store is a DataFrame built once from hashes and joined with queries.  Bins are
the hash modulo each of a few primes, so two builds of a store agree bit by bit.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.blocks import Kernel, counted_hashes, summed_hashes
from strandlake.functions.hashing import primes_near, unsigned_key, unsigned_mod
from strandlake.tables import ship_package, stored

#: Bits, or twice the counts, that a task holds one by one; stores of more are added up by shuffles.
DENSE = 1 << 25
#: Keys of a mask that is sent to all tasks.
MASK = 1 << 20
#: Bins of a row in which a task hands its own on.
_PART = 1 << 12


def dense_sums(rows: DataFrame, size: int, place: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray | None]]], counted: bool, made: Kernel | None = None) -> DataFrame:
    """(place, count) of the bins 0..size-1 that were hit; ``counted``: how often, else 1.

    place: (bins, their weights or None) of a batch.  Each task adds up its own
    and hands on parts of the whole, as many as there are bins however many rows
    it read; parts are then added up.  made: an Arrow kernel that makes what
    ``place`` takes from the rows, run in the same task.
    """
    ship_package(rows)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(-(-size // _PART) * _PART, np.int64 if counted else bool)
        for batch in made(batches) if made else batches:
            for at, weight in place(batch):
                if not counted:
                    held[at] = True
                elif weight is not None:
                    np.add.at(held, at, weight)
                elif len(at) > len(held) // 8:
                    held += np.bincount(at, minlength=len(held))
                else:
                    np.add.at(held, at, 1)
        table = held.reshape(-1, _PART)
        for part in np.flatnonzero(table.any(axis=1)):
            top = int(table[part].max())
            data = table[part].astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8") if counted else np.packbits(table[part])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["part", "data"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if counted:
                    more = np.frombuffer(data, f"<u{len(data) // _PART}").astype(np.int64)
                    held[part] = held[part] + more if part in held else more
                else:
                    more = np.frombuffer(data, np.uint8)
                    held[part] = held[part] | more if part in held else more
        for part, data in held.items():
            if not counted:
                data = np.unpackbits(data)
            hit = np.flatnonzero(data)
            yield pa.RecordBatch.from_arrays([pa.array(part * _PART + hit), pa.array(data[hit].astype(np.int64))], names=["place", "count"])

    n = min(-(-size // _PART), max(rows.sparkSession.sparkContext.defaultParallelism, size // (1 << 20)))
    return rows.mapInArrow(own, "part int, data binary").repartition(n, "part").mapInArrow(total, "place long, count long")


def _dense_bins(hashes: DataFrame, sizes: list[int], key: str, counted: bool, weight: str | None, made: Kernel | None) -> DataFrame:
    """(tab, bin, count) of tables of ``sizes``, by ``dense_sums``."""
    edges = np.concatenate(([0], np.cumsum(sizes))).tolist()

    def place(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        h, w = batch.column(key), None if weight is None else np.asarray(batch.column(weight)).astype(np.int64)
        if h.null_count:
            known = np.asarray(h.is_valid())
            h, w = h.drop_null(), None if w is None else w[known]
        h = np.asarray(h).view(np.uint64)
        for edge, p in zip(edges, sizes, strict=False):
            yield (h % np.uint64(p)).astype(np.int64) + edge, w

    rows = hashes if made else hashes.select(key, *([weight] if weight else []))
    out = dense_sums(rows, edges[-1], place, counted, made)
    tab = F.lit(0)
    start = F.lit(0).cast("long")
    for i, edge in enumerate(edges[1:-1], 1):
        tab, start = F.when(F.col("place") >= edge, F.lit(i)).otherwise(tab), F.when(F.col("place") >= edge, F.lit(edge).cast("long")).otherwise(start)
    return out.select(tab.alias("tab"), (F.col("place") - start).alias("bin"), "count")


def exact_counts(hashes: DataFrame, key: str = "h", weight: str | None = None) -> DataFrame:
    """(key, count); partial counts are summed before the shuffle.  weight: a column of counts to add up instead of rows."""
    return hashes.groupBy(key).agg((F.count("*") if weight is None else F.sum(weight)).alias("count"))


def exact_set(hashes: DataFrame, key: str = "h") -> DataFrame:
    return hashes.select(key).distinct()


def query(store: DataFrame, hashes: DataFrame, key: str = "h") -> DataFrame:
    """Rows of ``hashes`` with their count in the store, 0 where absent."""
    return hashes.join(store, key, "left").withColumn("count", F.coalesce("count", F.lit(0)))


def masked(store: DataFrame, mask: DataFrame, key: str = "h", bounded: bool = False) -> DataFrame:
    """Rows of a store without the mask's; bounded: the mask is written first, and goes to all tasks, which then need no shuffle of the store, if it has at most MASK keys."""
    gone = mask.select(key).distinct()
    if bounded:
        gone = stored(gone, "mask")
        gone = F.broadcast(gone) if gone.count() <= MASK else gone
    return store.join(gone, key, "left_anti")


def _bins(hashes: DataFrame, sizes: list[int], key: str) -> DataFrame:
    tables = F.array(*[F.struct(F.lit(i).alias("tab"), unsigned_mod(F.col(key), p).alias("bin")) for i, p in enumerate(sizes)])
    return hashes.select(key, F.explode(tables).alias("b")).select(key, "b.tab", "b.bin")


def table_sizes(table_size: int, n_tables: int) -> list[int]:
    return primes_near(n_tables, table_size)


def bloom(hashes: DataFrame, sizes: list[int], key: str = "h", made: Kernel | None = None) -> DataFrame:
    """Occupied bins (tab, bin).  made: an Arrow kernel that makes hashes of the rows, run in the same task; tables of up to DENSE bins then need no shuffle of hashes."""
    if sum(sizes) <= DENSE:
        return _dense_bins(hashes, sizes, key, False, None, made).select("tab", "bin")
    hashes = hashes.mapInArrow(made, f"`{key}` long") if made else hashes
    return _bins(hashes.select(key).distinct(), sizes, key).select("tab", "bin").distinct()


def bloom_query(store: DataFrame, hashes: DataFrame, sizes: list[int], key: str = "h") -> DataFrame:
    """(key, count): 1 where every table's bin is occupied."""
    hits = _bins(hashes.select(key).distinct(), sizes, key).join(store.withColumn("hit", F.lit(1)), ["tab", "bin"], "left")
    return hits.groupBy(key).agg((F.count("hit") == len(sizes)).cast("int").alias("count"))


def bloom_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def count_min(hashes: DataFrame, sizes: list[int], cap: int = 255, key: str = "h", weight: str | None = None, made: Kernel | None = None) -> DataFrame:
    """(tab, bin, count): increments per bin up to ``cap`` (255 for bytes, 15 for nibbles, 65,535 with big counts).  made: as for ``bloom``."""
    if sum(sizes) <= DENSE // 2:
        return _dense_bins(hashes, sizes, key, True, weight, made).select("tab", "bin", F.least("count", F.lit(cap)).cast("int").alias("count"))
    hashes = hashes.mapInArrow(made, f"`{key}` long") if made else hashes
    counts = exact_counts(hashes, key, weight)
    tables = F.array(*[F.struct(F.lit(i).alias("tab"), unsigned_mod(F.col(key), p).alias("bin")) for i, p in enumerate(sizes)])
    rows = counts.select("count", F.explode(tables).alias("b")).select("b.tab", "b.bin", "count")
    return rows.groupBy("tab", "bin").agg(F.least(F.sum("count"), F.lit(cap)).cast("int").alias("count"))


def count_min_query(store: DataFrame, hashes: DataFrame, sizes: list[int], key: str = "h") -> DataFrame:
    """(key, count): the least count of the tables."""
    hits = _bins(hashes.select(key).distinct(), sizes, key).join(store, ["tab", "bin"], "left")
    return hits.groupBy(key).agg(F.min(F.coalesce("count", F.lit(0))).alias("count"))


def quotient_counts(hashes: DataFrame, size: int, key: str = "h", weight: str | None = None, made: Kernel | None = None) -> DataFrame:
    """(slot, count) of a counting quotient filter with 2**size slots and 8 remainder bits.  made: as for ``bloom``."""
    if 1 << (size + 8) <= DENSE // 2:
        return _dense_bins(hashes, [1 << (size + 8)], key, True, weight, made).select(F.col("bin").alias("slot"), "count")
    hashes = hashes.mapInArrow(made, f"`{key}` long") if made else hashes
    slots = hashes.select(F.col(key).bitwiseAND(F.lit((1 << (size + 8)) - 1)).alias("slot"), *([weight] if weight else []))
    return summed_hashes(slots, "slot", weight)


def n_unique_estimate(hashes: DataFrame, error: float = 0.01, key: str = "h") -> DataFrame:
    """Distinct hashes by a HyperLogLog sketch with a standard error of at most ``error`` (0.0003 is the least there is)."""
    bits = max(4, math.ceil(math.log2((1.04 / error) ** 2)))
    if bits > 21:
        raise ValueError("no sketch has so small an error")
    return hashes.agg(F.hll_sketch_estimate(F.hll_sketch_agg(key, bits)).alias("n_unique"))


def most_frequent(hashes: DataFrame, n: int, key: str = "h", weight: str | None = None) -> DataFrame:
    """(key, count) of the n most frequent hashes, of equal ones the lesser: partial counts, then a top-n of each task."""
    return exact_counts(hashes, key, weight).orderBy(F.desc("count"), unsigned_key(F.col(key))).limit(n)


def ordered(store: DataFrame, key: str = "h") -> DataFrame:
    """A store's rows in ascending order of unsigned hashes, range-partitioned, for scans in order."""
    return store.orderBy(unsigned_key(F.col(key)))


def occupancy(store: DataFrame, sizes: list[int]) -> DataFrame:
    """(n_occupied, estimated_fp) of a binned store, from its first table."""
    n = F.count_if(F.col("tab") == 0)
    return store.agg(n.alias("n_occupied"), F.pow(n / sizes[0], F.lit(len(sizes))).alias("estimated_fp"))


def partition_counts(hashes: DataFrame, n_partitions: int, key: str = "h", partition: str = "partition") -> DataFrame:
    """Dense (partition, n_unique) over all partitions 0..n-1."""
    own = hashes.select(partition, key).distinct().groupBy(partition).agg(F.count("*").alias("n_unique"))
    return dense_partitions(own, n_partitions, partition)


def dense_partitions(own: DataFrame, n_partitions: int, partition: str = "partition") -> DataFrame:
    """(partition, n_unique) with a row of 0 for each of 0..n-1 that has none."""
    every = own.sparkSession.range(n_partitions).withColumnRenamed("id", partition)
    return every.join(own, partition, "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))


class Partitioned:
    """A store for each minimizer partition, held as one table whose rows carry their partition.

    Hashes come as (partition, h); equal hashes of different partitions are
    different entries.  Bins are of each partition's own tables.
    """

    def __init__(self, shape: Shape, n_partitions: int, rows: DataFrame):
        self.shape, self.n_partitions, self.rows = shape, n_partitions, rows

    @classmethod
    def build(cls, hashes: DataFrame, shape: Shape, n_partitions: int, made: Kernel | None = None) -> Partitioned:
        """Of (partition, h) rows.  made: an Arrow kernel that makes them, null partitions too, from rows of another kind, run in the same task."""
        if shape.kind == "exact" and made:
            return cls(shape, n_partitions, counted_hashes(hashes, made))
        counted = shape.kind != "bloom"
        if shape.kind not in ("exact", "cqf") and n_partitions * sum(shape.sizes) <= (DENSE // 2 if counted else DENSE):
            return cls(shape, n_partitions, cls._dense(hashes, shape, n_partitions, counted, made))
        if made:
            hashes = hashes.mapInArrow(lambda batches: (b.select(["partition", "h"]) for b in made(batches)), "partition long, h long").where("partition is not null")
        counts = hashes.groupBy("partition", "h").agg(F.count("*").alias("count"))
        if shape.kind == "exact":
            return cls(shape, n_partitions, counts)
        if shape.kind == "cqf":
            slot = F.col("h").bitwiseAND(F.lit((1 << (shape.slots + 8)) - 1)).alias("slot")
            return cls(shape, n_partitions, counts.groupBy("partition", slot).agg(F.sum("count").alias("count")))
        bins = cls._bins(counts, shape, "count").groupBy("partition", "tab", "bin")
        cap = 1 if shape.kind == "bloom" else CAPS[shape.kind]
        return cls(shape, n_partitions, bins.agg(F.least(F.sum("count"), F.lit(cap)).cast("int").alias("count")))

    @staticmethod
    def _dense(hashes: DataFrame, shape: Shape, n_partitions: int, counted: bool, made: Kernel | None) -> DataFrame:
        """(partition, tab, bin, count) by ``dense_sums``: a table after the other, and in it a partition after the other."""
        edges = (n_partitions * np.concatenate(([0], np.cumsum(shape.sizes)))).tolist()
        sizes = list(shape.sizes)

        def place(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
            known = np.asarray(pc.and_(batch.column("partition").is_valid(), batch.column("h").is_valid()))
            part, h = (np.asarray(batch.column(c).filter(pa.array(known))).astype(np.int64) for c in ("partition", "h"))
            for edge, p in zip(edges, sizes, strict=False):
                yield edge + part * p + (h.view(np.uint64) % np.uint64(p)).astype(np.int64), None

        out = dense_sums(hashes if made else hashes.select("partition", "h"), edges[-1], place, counted, made)
        at = F.col("place")
        cells = F.struct(F.lit(0).alias("tab"), F.lit(0).cast("long").alias("edge"), F.lit(sizes[0]).alias("size"))
        for i in range(1, len(sizes)):
            cells = F.when(at >= edges[i], F.struct(F.lit(i).alias("tab"), F.lit(edges[i]).cast("long").alias("edge"), F.lit(sizes[i]).alias("size"))).otherwise(cells)
        rows = out.withColumn("c", cells).withColumn("o", at - F.col("c.edge"))
        cap = CAPS.get(shape.kind, 1)
        return rows.select(F.floor(F.col("o") / F.col("c.size")).alias("partition"), "c.tab", (F.col("o") % F.col("c.size")).alias("bin"), F.least("count", F.lit(cap)).cast("int").alias("count"))

    def own(self) -> DataFrame:
        """(partition, h, count) of all that an exact store holds: what ``query`` says of the rows it was built of."""
        if self.shape.kind != "exact":
            raise ValueError("only an exact store lists what it holds")
        return self.rows.select("partition", "h", "count")

    @staticmethod
    def _bins(rows: DataFrame, shape: Shape, *keep: str) -> DataFrame:
        tables = F.array(*[F.struct(F.lit(i).alias("tab"), unsigned_mod(F.col("h"), p).alias("bin")) for i, p in enumerate(shape.sizes)])
        return rows.select("partition", "h", *keep, F.explode(tables).alias("b")).select("partition", "h", *keep, "b.tab", "b.bin")

    def query(self, hashes: DataFrame) -> DataFrame:
        """(partition, h, count) of the distinct (partition, h) asked for."""
        own = hashes.select("partition", "h").distinct()
        if self.shape.kind in ("exact", "cqf"):
            key = "h" if self.shape.kind == "exact" else "slot"
            if key == "slot":
                own = own.withColumn("slot", F.col("h").bitwiseAND(F.lit((1 << (self.shape.slots + 8)) - 1)))
            return own.join(self.rows, ["partition", key], "left").select("partition", "h", F.coalesce("count", F.lit(0)).alias("count"))
        hits = self._bins(own, self.shape).join(self.rows, ["partition", "tab", "bin"], "left")
        return hits.groupBy("partition", "h").agg(F.min(F.coalesce("count", F.lit(0))).alias("count"))

    def report(self) -> DataFrame:
        """Dense (partition, n_occupied, estimated_fp): occupied bins of the first table (rows of an exact store), and (occupied / size) ** tables."""
        binned = self.shape.kind not in ("exact", "cqf")
        rows = self.rows.where("tab = 0") if binned else self.rows
        own = rows.groupBy("partition").agg(F.count("*").alias("n_occupied"))
        every = self.rows.sparkSession.range(self.n_partitions).withColumnRenamed("id", "partition").join(own, "partition", "left")
        n = F.coalesce("n_occupied", F.lit(0))
        fp = F.pow(n / self.shape.sizes[0], F.lit(self.shape.n_tables)) if binned else F.lit(0.0)
        return every.select("partition", n.alias("n_occupied"), fp.alias("estimated_fp"))

    def totals(self) -> DataFrame:
        """(n_occupied, estimated_fp): the sum and the mean over all partitions."""
        return self.report().agg(F.sum("n_occupied").alias("n_occupied"), F.avg("estimated_fp").alias("estimated_fp"))


#: Largest count of the counting bins.
CAPS = {"cms8": 255, "cms4": 15, "cms16": 65_535}


KINDS = ("exact", "bloom", "cms8", "cms4", "cms16", "cqf")


@dataclass(frozen=True)
class Shape:
    """What a store is made of; stores of one shape can be united and compared."""

    kind: str = "exact"
    k: int = 31
    table_size: int = 1_000_000
    n_tables: int = 4

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown store {self.kind}")

    @classmethod
    def of_args(cls, kind: str, k: int, table_size: float, n_tables: int = 4) -> Shape:
        """From what a command line says."""
        return cls(kind, k, int(table_size), n_tables)

    @property
    def probabilistic(self) -> bool:
        return self.kind != "exact"

    @property
    def counting(self) -> bool:
        return self.kind != "bloom"

    @property
    def sizes(self) -> list[int]:
        return table_sizes(self.table_size, self.n_tables)

    @property
    def slots(self) -> int:
        """Bits that a quotient filter's slots need."""
        return max(1, (self.table_size - 1).bit_length())


class Store:
    """A store by name: build, query, unite, save and load."""

    def __init__(self, shape: Shape, rows: DataFrame):
        self.shape, self.rows = shape, rows

    @classmethod
    def build(cls, hashes: DataFrame, shape: Shape, weight: str | None = None) -> Store:
        """Of hashes (h), each counted once, or ``weight`` times."""
        if shape.kind == "exact":
            return cls(shape, summed_hashes(hashes, "h", weight))
        if shape.kind == "bloom":
            return cls(shape, bloom(hashes, shape.sizes))
        if shape.kind == "cqf":
            return cls(shape, quotient_counts(hashes, shape.slots, weight=weight))
        return cls(shape, count_min(hashes, shape.sizes, CAPS[shape.kind], weight=weight))

    def empty(self) -> Store:
        """A store of the same shape without rows."""
        return Store(self.shape, self.rows.limit(0))

    def n_occupied(self) -> DataFrame:
        """(n_occupied): bins of the first table, slots, or keys."""
        rows = self.rows.where("tab = 0") if "tab" in self.rows.columns else self.rows
        return rows.agg(F.count("*").alias("n_occupied"))

    def estimated_fp(self) -> DataFrame:
        """(estimated_fp): (occupied / size) ** tables; 0 of an exact store."""
        if self.shape.kind == "exact":
            return self.rows.limit(0).agg(F.lit(0.0).alias("estimated_fp"))
        n, size, tables = F.col("n_occupied"), self.shape.sizes[0], self.shape.n_tables
        if self.shape.kind == "cqf":
            size, tables = 1 << (self.shape.slots + 8), 1
        return self.n_occupied().select(F.pow(n / size, F.lit(tables)).alias("estimated_fp"))

    def query(self, hashes: DataFrame) -> DataFrame:
        """(h, count) of the distinct ``hashes``; presence stores count 1."""
        kind, own = self.shape.kind, hashes.select("h").distinct()
        if kind == "exact":
            return query(self.rows, own)
        if kind == "bloom":
            return bloom_query(self.rows, own, self.shape.sizes)
        if kind == "cqf":
            slot = own.withColumn("slot", F.col("h").bitwiseAND(F.lit((1 << (self.shape.slots + 8)) - 1)))
            return query(self.rows, slot, "slot").select("h", "count")
        return count_min_query(self.rows, own, self.shape.sizes)

    def union(self, other: Store) -> Store:
        """A store of both inputs; counts add up, to the cap where there is one."""
        if self.shape != other.shape:
            raise ValueError("stores differ in shape")
        both = self.rows.unionByName(other.rows)
        if self.shape.kind == "bloom":
            return Store(self.shape, both.distinct())
        keys = [c for c in both.columns if c != "count"]
        if len(keys) == 1:
            return Store(self.shape, summed_hashes(both, keys[0], "count"))
        cap = CAPS.get(self.shape.kind)
        total = F.sum("count") if cap is None else F.least(F.sum("count"), F.lit(cap)).cast("int")
        return Store(self.shape, both.groupBy(*keys).agg(total.alias("count")))

    def save(self, path: str) -> None:
        """Parquet rows beside one line of JSON with the shape, which is written last."""
        self.rows.write.parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame([(json.dumps(asdict(self.shape)),)], "value string").write.text(f"{path}/shape")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Store:
        shape = Shape(**json.loads(spark.read.text(f"{path}/shape").first()[0]))
        return cls(shape, spark.read.parquet(f"{path}/rows"))
