"""Tables written to the folder that driver and executors share.

Multi-pass operators cut lineage by writing a Parquet table below
``spark.checkpoint.dir``, so that a lost executor costs a re-read and not a
recomputation.  The folder may be on any file system that Spark can write.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows of an Arrow batch at most: texts are long, and a batch stands in memory on both sides.
BATCH_ROWS = 1000
#: The C library of a worker gives freed arrays back instead of keeping them for the next stage.
_MALLOC = {"MALLOC_MMAP_THRESHOLD_": str(16 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20), "MALLOC_ARENA_MAX": "2"}


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, and keep their memory small."""
    env = spark.sparkContext.environment
    for name, value in _MALLOC.items():
        env.setdefault(name, value)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; on a cluster that
    is an error, as executors could not read the driver's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of the driver's Hadoop client."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/strandlake/{label}-{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back with its schema."""
    spark = df.sparkSession
    path = new_folder(spark, label) + "/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put_file(spark: SparkSession, label: str, data: bytes) -> str:
    """Write bytes to the shared folder and ship them to all machines; returns the name for ``shipped``."""
    name = f"{label}-{uuid.uuid4().hex}"
    path = f"{new_folder(spark, label)}/{name}"
    fs, p = hadoop_path(spark, path)
    out = fs.create(p, False)
    try:
        for k in range(0, len(data), 1 << 22):
            out.write(bytearray(data[k : k + (1 << 22)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


def ship_file(spark: SparkSession, path: str) -> str:
    """Ship a file of the driver to all machines; returns the name for ``shipped``."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def shipped(name: str) -> str:
    """In a task: the local path of a file that was shipped."""
    return SparkFiles.get(name)


def dealt(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """A small stored list, a row or few a task: an explicit number of partitions, which nothing coalesces again."""
    return rows.repartition(max(1, min(most, rows.count())))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys that are told apart by a broadcast, at most; a key counts as hot from HOT_ROWS rows on.
HOT_KEYS, HOT_ROWS = 50_000, 1000


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str) -> DataFrame:
    """rows left-joined with ``groups`` (one row a key, stored) so that no key's rows meet in one task.

    Groups of at least max(HOT_ROWS, all rows in groups / HOT_KEYS) rows are HOT_KEYS
    at most and are broadcast; their rows take part in the shuffled join of the
    other groups under a key of their own, made of ``spread``, that matches nothing.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    others = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) >= least).select(key, *[F.col(c).alias(f"__hot_{c}") for c in others])
    cold = groups.where(F.col(size) < least).select(F.col(key).alias("__key"), *[F.col(c).alias(f"__cold_{c}") for c in others])
    marked = rows.join(F.broadcast(hot), key, "left")
    is_hot = F.col(f"__hot_{size}").isNotNull()
    kind = dict(rows.dtypes)[key]
    apart = F.xxhash64(spread, key) if kind == "bigint" else F.concat(F.lit("#"), F.xxhash64(spread, key).cast("string"))
    joined = marked.withColumn("__key", F.when(is_hot, apart).otherwise(F.col(key))).join(cold, "__key", "left")
    picked = [F.when(is_hot, F.col(f"__hot_{c}")).otherwise(F.col(f"__cold_{c}")).alias(c) for c in others]
    return joined.select(*rows.columns, *picked)


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)
