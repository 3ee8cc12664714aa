"""Intermediate tables of iterative operators, in the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

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


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared root, deleted when the session ends."""
    path = f"{shared_root(spark)}/strandlake/{label}-{uuid.uuid4().hex}"
    files, p = _hadoop(spark, path)
    files.deleteOnExit(p)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a shared path and read it back; cuts the lineage of loops."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Relay:
    """The state of a loop: each ``put`` stores the next table and deletes the one before."""

    def __init__(self, label: str):
        self.label, self.path = label, None

    def put(self, df: DataFrame) -> DataFrame:
        spark, path = df.sparkSession, shared_path(df.sparkSession, self.label)
        df.write.parquet(path)
        if self.path is not None:
            files, p = _hadoop(spark, self.path)
            files.delete(p, True)
        self.path = path
        return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the cluster has cores, dealt to all of them; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship_package(df: DataFrame) -> None:
    """Let Python workers import this package from where the driver did."""
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
