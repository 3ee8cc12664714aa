"""Compacted graphs as FASTA, GFA 1, GraphML and edge lines; minimizers as CSV; streams as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.hashing import unsigned_text
from strandlake.operators.graph import Compacted


def _name(key: Column) -> Column:
    return F.concat(F.lit("NODE"), unsigned_text(F.xxhash64(key)))


def graph_nodes(graph: Compacted) -> DataFrame:
    """(name, sequence, meta) of unitigs and decision nodes."""
    unitigs = graph.unitigs.select(_name(F.col("left_end")).alias("name"), "sequence", "meta")
    return unitigs.unionByName(graph.dnodes.select(_name(F.col("kmer")).alias("name"), F.col("kmer").alias("sequence"), F.lit("DECISION").alias("meta")))


def graph_links(graph: Compacted) -> DataFrame:
    """(source, sink) by node name."""
    key = lambda c: _name(F.substr(F.col(c), F.lit(3)))
    return graph.links().select(key("source").alias("source"), key("sink").alias("sink"))


def fasta_lines(graph: Compacted) -> DataFrame:
    return graph_nodes(graph).select(F.format_string(">ID=%s L=%d type=%s\n%s", "name", F.length("sequence"), "meta", "sequence").alias("value"))


def gfa_lines(graph: Compacted, overlap: int | None = None) -> DataFrame:
    """Segments and links; ``overlap`` is what links state, k-1 by default (some readers expect k)."""
    segments = graph_nodes(graph).select(F.lit(0).alias("o"), F.format_string("S\t%s\t%s\tLN:i:%d", "name", "sequence", F.length("sequence")).alias("value"))
    overlap = graph.k - 1 if overlap is None else overlap
    links = graph_links(graph).select(F.lit(1).alias("o"), F.format_string(f"L\t%s\t+\t%s\t+\t{overlap}M\tID:Z:LINK-%s-%s", "source", "sink", "source", "sink").alias("value"))
    return segments.unionByName(links)


def graphml_lines(graph: Compacted) -> DataFrame:
    nodes = graph_nodes(graph).select(F.lit(1).alias("o"), F.format_string('<node id="%s"><data key="sequence">%s</data><data key="meta">%s</data></node>', "name", "sequence", "meta").alias("value"))
    links = graph_links(graph).select(F.lit(2).alias("o"), F.format_string('<edge source="%s" target="%s"/>', "source", "sink").alias("value"))
    return nodes.unionByName(links)


#: Opening lines of the formats; fixed values.
_HEADS = {
    "gfa1": ["H\tVN:Z:1.0"],
    "graphml": [
        '<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
        '<key id="sequence" for="node" attr.name="sequence" attr.type="string"/>', '<key id="meta" for="node" attr.name="meta" attr.type="string"/>',
        '<graph edgedefault="directed">',
    ],
}


def write_graph(graph: Compacted, path: str, kind: str = "gfa1") -> None:
    """A folder of part files in order; kinds: gfa1, graphml, fasta."""
    if kind == "fasta":
        fasta_lines(graph).write.text(path)
        return
    if kind not in _HEADS:
        raise ValueError(f"unknown graph format {kind}")
    lines = gfa_lines(graph) if kind == "gfa1" else graphml_lines(graph)
    spark = lines.sparkSession
    head = spark.createDataFrame([(-1, "\n".join(_HEADS[kind]))], "o int, value string")
    foot = spark.createDataFrame([(9, "</graph>\n</graphml>")] if kind == "graphml" else [], "o int, value string")
    # the frame's rows have numbers of their own, so a range sort keeps them first and last
    lines.unionByName(head).unionByName(foot).orderBy("o", "value").select("value").write.text(path)


def minimizer_csv(minimizers: DataFrame, path: str) -> None:
    """Rows of sequence number, position, hash and k-mer, without a header."""
    h = F.col("h") if dict(minimizers.dtypes)["h"] == "string" else unsigned_text(F.col("h"))
    minimizers.select("seq_no", "pos", h, "kmer").write.csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
