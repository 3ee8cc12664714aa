"""Command line: ``python -m strandlake COMMAND``.

A command goes through four steps: its arguments are checked, its inputs are
set up as tables, it is executed, and its reports are written.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import distances
from strandlake.functions.hashing import hashed_kmers
from strandlake.functions.murmur import murmur_kmers
from strandlake.kmers import PACKED_K, kmers, packed_kmers
from strandlake.operators import filters, graph, hitting, saturation, sketch, windows
from strandlake.sources import fastx, graph_files, signatures
from strandlake.tables import stored


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake")
    groups = top.add_subparsers(dest="group", required=True)

    def command(group, name: str, run, out: bool = True) -> argparse.ArgumentParser:
        p = group.add_parser(name)
        p.set_defaults(run=run, check=None)
        p.add_argument("-i", "--inputs", nargs="+", required=True)
        p.add_argument("--pairing-mode", choices=("single", "interleaved", "split"), default="single")
        p.add_argument("--names", nargs="+")
        p.add_argument("--interval", type=int, default=500_000)
        p.add_argument("-K", type=int, default=31)
        if out:
            p.add_argument("-o", "--output", required=True)
        return p

    def saturating(p: argparse.ArgumentParser, cutoff: float) -> None:
        p.add_argument("--saturate", action="store_true", help="sketch only the reads up to saturation")
        p.add_argument("--distance-output", help="write the distances of intervals there")
        p.add_argument("--save-stream", help="write the sketches of each --save-every-th interval there")
        p.add_argument("--save-every", type=int, default=1)
        p.add_argument("--smoothing-function", choices=("mean", "median", "stddev"), default="mean")
        p.add_argument("--cutoff-function", choices=("all", "median"), default="all")
        p.add_argument("--cutoff", type=float, default=cutoff)
        p.add_argument("--window-size", type=int, default=5)

    sub = lambda name: groups.add_parser(name).add_subparsers(dest="command", required=True)
    sketches = sub("sketch")
    p = command(sketches, "minhash", run_minhash)
    p.add_argument("-N", type=int, default=2500)
    p.add_argument("--scaled", type=int, default=0)
    saturating(p, 0.999)
    p = command(sketches, "draff", run_draff)
    p.set_defaults(K=9)
    p.add_argument("-W", type=int, default=31)
    p.add_argument("--hitting-set", help="a file of k-mers, one a line; by default the least set for K")
    p.add_argument("--distance-metric", choices=sorted(set(distances.METRICS) - {"seuclidean", "mahalanobis", "jaccard", "containment"}), default="cosine")
    saturating(p, 0.001)
    p = command(sub("graph"), "build", run_graph)
    p.add_argument("--format", choices=("gfa1", "graphml", "fasta"), default="gfa1")
    p.add_argument("--canonical", action="store_true")
    p.add_argument("--validate", nargs="?", const="", help="compare with the reads' k-mers; write the result there, or show it")
    p.add_argument("--normalize", type=int, help="take in only reads that digital normalisation at this cutoff passes")
    p.add_argument("--solid", type=int, default=1, help="take in only k-mers found so often")
    p.add_argument("--track-metrics", help="write counts of nodes after intervals there")
    p.add_argument("--track-unitig-bp", help="write k-mers by unitig length after intervals there")
    p.add_argument("--unitig-bp-bins", type=int, nargs="+")
    p.add_argument("--track-components", help="write component sizes after intervals there")
    p.add_argument("--tick", default="fib", help="after which intervals: fib, exp, or each n-th")
    p.set_defaults(check=check_graph)
    filter_ = sub("filter")
    p = command(filter_, "solid", run_solid)
    p.add_argument("-C", type=int, default=1)
    p.add_argument("-P", type=float, default=0.75)
    p.add_argument("--metrics")
    p = command(filter_, "diginorm", run_diginorm)
    p.add_argument("-C", type=int, default=10)
    p.add_argument("--metrics")
    utils = sub("utils")
    command(utils, "merge-paired", run_merge)
    p = command(utils, "hash-stream", run_hash, out=False)
    p.add_argument("--graph", action="store_true", help="count the k-mers too")
    p.add_argument("--metrics")
    return top


def _reads(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Reads of all samples; ``seq_no`` counts mates as reads of their own, left first."""
    rows = fastx.read_samples(spark, args.inputs, args.pairing_mode, args.names)
    return rows.withColumn("seq_no", F.when(F.col("mate") == 0, F.col("seq_no")).otherwise(F.col("seq_no") * 2 + F.col("mate") - 1))


def _kmers(reads: DataFrame, k: int, keep: tuple[str, ...] = ("seq_no",)) -> DataFrame:
    return (packed_kmers if k <= PACKED_K else kmers)(reads, k, keep)


def _samples(reads: DataFrame) -> list[str]:
    return [r.sample for r in reads.select("sample").distinct().orderBy("sample").toLocalIterator()]


def _json(df: DataFrame, path: str) -> None:
    graph_files.json_lines(df, path)


def _saturated(args: argparse.Namespace, rows: DataFrame, curve: DataFrame, above: bool, sample: str) -> DataFrame:
    """The reads to sketch; distances are written on the way."""
    decided = stored(saturation.decided(curve, args.window_size, args.cutoff, args.smoothing_function, args.cutoff_function, above), "curve")
    if args.distance_output:
        ends = saturation.tick_ends(rows)
        _json(decided.join(ends, "tick").select(F.lit(sample).alias("sample_name"), "t", "sequence", "distance", "stat", "reached"), f"{args.distance_output}/{sample}")
    return saturation.saturated(rows, decided) if args.saturate else rows


def _stream(args: argparse.Namespace, rows: DataFrame, sample: str, signature) -> None:
    """Signatures of everything up to each chosen interval."""
    last = rows.agg(F.max("tick")).first()[0]
    for tick in range(args.save_every - 1, (last if last is not None else -1) + 1, args.save_every):
        signatures.write_signatures(signature(rows.where(F.col("tick") <= tick), f"{sample}:{tick}"), f"{args.save_stream}/{sample}/tick={tick}")


def run_minhash(spark: SparkSession, args: argparse.Namespace) -> None:
    reads, out = _reads(spark, args), None

    def signature(rows: DataFrame, name: str) -> DataFrame:
        hashes = murmur_kmers(rows, args.K)
        if args.scaled:
            own, top, num = sketch.scaled(hashes, args.scaled), sketch.max_hash_for_scaled(args.scaled), 0
        else:
            own, top, num = sketch.bottom(hashes, args.N), 0, args.N
        return signatures.minhash_signatures(own.withColumn("sample", F.lit(name)), args.K, num, top, name="sample")

    for sample in _samples(reads):
        rows = saturation.ticked(reads.where(F.col("sample") == sample), args.K, args.interval)
        if args.saturate or args.distance_output:
            rows = _saturated(args, rows, saturation.minhash_curve(rows, args.K, args.N), True, sample)
        if args.save_stream:
            _stream(args, rows, sample, signature)
        own = signature(rows, sample)
        out = own if out is None else out.unionByName(own)
    if out is not None:
        signatures.write_signatures(out, args.output)


def run_draff(spark: SparkSession, args: argparse.Namespace) -> None:
    reads, out = _reads(spark, args), None
    hits = hitting.load_hitting_set(spark, args.hitting_set, args.K) if args.hitting_set else hitting.hitting_set(spark, hitting.decycling_set(args.K), args.K)
    hits = stored(hits, "hitting-set")
    n = hits.agg(F.max("partition") + 1).first()[0]

    def signature(rows: DataFrame, name: str) -> DataFrame:
        wmer = hitting.wmers(rows, args.W, args.K, hits).where("partition is not null").withColumn("sample", F.lit(name))
        return signatures.partition_signatures(sketch.partition_sketch(wmer, n, "sample"), args.W, args.K, "sample")

    for sample in _samples(reads):
        rows = saturation.ticked(reads.where(F.col("sample") == sample), args.W, args.interval)
        if args.saturate or args.distance_output:
            rows = _saturated(args, rows, saturation.partition_curve(rows, args.W, args.K, hits, args.distance_metric), args.distance_metric == "angular", sample)
        if args.save_stream:
            _stream(args, rows, sample, signature)
        own = signature(rows, sample)
        out = own if out is None else out.unionByName(own)
    if out is not None:
        signatures.write_signatures(out, args.output)


def check_graph(args: argparse.Namespace) -> None:
    if args.tick not in ("fib", "exp") and not args.tick.isdigit():
        raise SystemExit("--tick is fib, exp or a number")


def run_graph(spark: SparkSession, args: argparse.Namespace) -> None:
    reads = _reads(spark, args)
    if args.normalize:
        passed = filters.digital_normalisation(reads, args.K, args.normalize).where("passed").select("sample", "seq_no")
        reads = reads.join(passed, ["sample", "seq_no"], "left_semi")
    node = stored(graph.nodes(_kmers(reads, args.K)).where(F.col("count") >= args.solid), "graph-nodes")
    if args.track_metrics or args.track_unitig_bp or args.track_components:
        _track(args, reads)
    built = graph.Compacted(node, args.K, args.canonical)
    graph_files.write_graph(built, args.output, args.format)
    if args.validate == "":
        built.validate().show()
    elif args.validate:
        _json(built.validate(), args.validate)
    built.metrics().show()


def _track(args: argparse.Namespace, reads: DataFrame) -> None:
    """Reports of the graph of everything up to chosen intervals, each graph made from the one before."""
    rows = stored(saturation.ticked(reads, args.K, args.interval), "ticked")
    last = rows.agg(F.max("tick")).first()[0] or 0
    chosen = {"fib": windows.fib_ticks, "exp": windows.exp_ticks}.get(args.tick, lambda n: windows.every_n(range(1, n + 1), int(args.tick)))(last + 1)
    ends = saturation.tick_ends(rows)
    made, before = None, 0
    bins = args.unitig_bp_bins or [args.K, 100, 200, 500, 1000]
    for tick in chosen:
        node = graph.nodes(_kmers(rows.where(F.col("tick").between(before, tick - 1)), args.K))
        made, before = (graph.Compacted(node, args.K, args.canonical) if made is None else made.updated(node)), tick
        at = ends.where(F.col("tick") <= tick - 1).agg(F.max("t").alias("t"), F.max("sequence").alias("seq_t"))
        for path, report in ((args.track_metrics, made.report), (args.track_unitig_bp, lambda: made.length_histogram(bins)), (args.track_components, made.component_stats)):
            if path:
                _json(at.crossJoin(report()), f"{path}/tick={tick}")


def _write_passed(spark: SparkSession, args: argparse.Namespace, verdicts) -> None:
    """Verdicts are of one sample; each sample has its folder."""
    reads = _reads(spark, args)
    for sample in _samples(reads):
        own = reads.where(F.col("sample") == sample)
        passed = stored(verdicts(own), "verdicts")
        fastx.write_fastx(own.join(passed.where("passed").select("seq_no"), "seq_no", "left_semi"), f"{args.output}/{sample}")
        if args.metrics:
            _json(filters.filter_metrics(passed.withColumn("sample", F.lit(sample)), args.interval), f"{args.metrics}/{sample}")


def run_solid(spark: SparkSession, args: argparse.Namespace) -> None:
    _write_passed(spark, args, lambda own: filters.solid_reads(_kmers(own, args.K), args.C, args.P))


def run_diginorm(spark: SparkSession, args: argparse.Namespace) -> None:
    _write_passed(spark, args, lambda own: filters.digital_normalisation(own, args.K, args.C))


def run_merge(spark: SparkSession, args: argparse.Namespace) -> None:
    if len(args.inputs) != 2:
        raise SystemExit("two inputs are needed")
    left, right = (fastx.scan_fastx(spark, p, sample=fastx.sample_name(args.inputs)) for p in args.inputs)
    fastx.write_fastx(fastx.interleaved(fastx.paired(left, right)), args.output, ("seq_no", "mate"))


def run_hash(spark: SparkSession, args: argparse.Namespace) -> None:
    began = time.monotonic()
    reads = _reads(spark, args)
    rows = hashed_kmers(reads, args.K, ("sample", "seq_no"))
    totals = rows.groupBy("sample", "h").agg(F.count("*").alias("n")) if args.graph else rows.withColumn("n", F.lit(1))
    own = totals.groupBy("sample").agg(F.sum("n").alias("t"), *([F.count("*").alias("n_unique_kmers")] if args.graph else []), F.bit_xor("h").alias("digest"))
    own = stored(own.drop("digest"), "hashed")
    if args.metrics:
        _json(own.withColumn("rt_elapsed_total", F.lit(time.monotonic() - began)), args.metrics)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if args.check:
        args.check(args)
    args.run(spark or SparkSession.builder.appName("strandlake").getOrCreate(), args)


if __name__ == "__main__":
    main()
