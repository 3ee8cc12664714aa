"""Connected components of link tables by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.scratch import stored


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours; partial aggregation keeps hubs cheap."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of the links; component is its least node.

    Star contraction (large-star, then small-star, until nothing moves) takes a
    number of rounds logarithmic in the diameter.  A hub's edges are spread by
    Spark's skew join, as only one row of its least neighbour stands opposite.
    Links with a null end or equal ends are ignored; no links give no rows.
    """
    edges = (
        links.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x <> y")
        .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        .distinct()
    )
    edges = stored(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least_neighbour(both), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        least = _least_neighbour(large)
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        edges = stored(small, "stars")
        now = edges.agg(F.count("*"), F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
