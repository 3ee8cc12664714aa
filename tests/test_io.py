"""Sources, sinks, signatures, streams and the command line."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.__main__ import main
from strandlake.functions.murmur import murmur64, murmur_kmers
from strandlake.kmers import kmers
from strandlake.operators import graph, sketch
from strandlake.sources import fastx, graph_files, signatures
from strandlake.streaming import runner
from strandlake.streaming.messages import DistanceCalc, Handlers, Message, SampleSaturated


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_murmur_vectors():
    row = lambda s: np.frombuffer(s, np.uint8).reshape(1, -1)
    assert int(murmur64(row(b"hello"), 0)[0]) == 0xCBD8A7B341BD9B02
    assert int(murmur64(np.zeros((1, 0), np.uint8), 0)[0]) == 0
    assert int(murmur64(row(b"The quick brown fox jumps over the lazy dog"), 0)[0]) == 0xE34BBC7BBC071B6C


def test_murmur_skips_ambiguous_and_joins_strands(spark):
    reads = spark.createDataFrame([(0, "ACGTNACGG"), (1, "CCGT"), (2, None), (3, "")], "seq_no long, sequence string")
    rows = _rows(murmur_kmers(reads, 4).select("seq_no", "pos", "h"))
    assert [(a, b) for a, b, _ in rows] == [(0, 0), (0, 5), (1, 0)]
    assert rows[1][2] == rows[2][2]


def test_fasta_over_lines_and_statuses(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">r1 one two\nACGT\nac\n>r2\nACGN\n>r3\t\nAC\n>r4\r\nGGGG\r\n")
    scan = fastx.scan_fastx(spark, f"file://{p}", min_length=3)
    assert [(r.seq_no, r.name, r.comment, r.sequence, r.status) for r in scan.orderBy("seq_no").collect()] == [
        (0, "r1", "one two", "ACGTAC", "ok"), (1, "r2", None, "ACGN", "symbol"), (2, "r3", "", "AC", "short"), (3, "r4", None, "GGGG", "ok"),
    ]
    assert _rows(fastx.scan_counts(scan)) == [(2, 2)]
    with pytest.raises(Exception, match="invalid record r2"):
        fastx.read_fastx(spark, f"file://{p}", strict=True).collect()


@pytest.mark.parametrize("split", [64, 1 << 27])
def test_split_files_keep_places(spark, tmp_path, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "a.fa").write_text("".join(f">n{i}\n{'ACGT' * (i % 5 + 1)}\n" for i in range(60)))
    (tmp_path / "a.fq").write_text("".join(f"@n{i} 1:N\n{'ACGT' * (i % 5 + 1)}\n+\n{'@+II' * (i % 5 + 1)}\n" for i in range(60)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        for name, quality in (("a.fa", None), ("a.fq", "@+II")):
            rows = fastx.read_fastx(spark, f"file://{tmp_path}/{name}").orderBy("seq_no").collect()
            assert [(r.seq_no, r.name, r.sequence, r.quality) for r in rows] == [(i, f"n{i}", "ACGT" * (i % 5 + 1), quality and quality * (i % 5 + 1)) for i in range(60)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_gzip_fastq_and_bad_frames(spark, tmp_path):
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write("@a\nACGT\n+\nIIII\n@b\nACG\n+\nIIII\n@c\nAC\n+\nII\n\n")
    scan = fastx.scan_fastx(spark, f"file://{tmp_path}/a.fq.gz")
    assert [(r.name, r.status) for r in scan.orderBy("seq_no").collect()] == [("a", "ok"), ("b", "format"), ("c", "ok")]
    (tmp_path / "none.fa").write_text("")
    assert fastx.read_fastx(spark, f"file://{tmp_path}/none.fa").count() == 0


def test_pairs_and_merge(spark, tmp_path):
    (tmp_path / "s_1.fq").write_text("@a/1\nACGT\n+\nIIII\n@b/1\nAAAA\n+\nIIII\n")
    (tmp_path / "s_2.fq").write_text("@a/2\nCCCC\n+\nIIII\n@x/2\nGGNG\n+\nIIII\n")
    left, right = (fastx.read_fastx(spark, f"file://{tmp_path}/s_{i}.fq", sample="s", alphabet="DNAN") for i in (1, 2))
    assert fastx.paired(left, right).count() == 2
    assert [r.left.name for r in fastx.paired(left, right, force_name_match=True).collect()] == ["a/1"]
    with pytest.raises(Exception, match="mates"):
        fastx.paired(left, right, strict=True, force_name_match=True).collect()
    main(["utils", "merge-paired", "-i", f"file://{tmp_path}/s_1.fq", f"file://{tmp_path}/s_2.fq", "-o", f"file://{tmp_path}/out"], spark)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [x for x in text.split("\n") if x.startswith("@")] == ["@a/1", "@a/2", "@b/1"]
    assert fastx.sample_name(["/d/s_1.fq.gz", "/d/s_2.fq.gz"]) == "s"


def test_graph_files(spark, tmp_path):
    reads = spark.createDataFrame([(0, "AAACCCGGT"), (1, "AAACCCTTA")], "seq_no long, sequence string")
    built = graph.Compacted(graph.nodes(kmers(reads, 4)), 4)
    for kind in ("gfa1", "graphml", "fasta"):
        graph_files.write_graph(built, f"file://{tmp_path}/{kind}", kind)
    lines = "".join(p.read_text() for p in sorted((tmp_path / "gfa1").glob("part-*"))).splitlines()
    assert lines[0] == "H\tVN:Z:1.0"
    names = {x.split("\t")[1] for x in lines if x.startswith("S")}
    links = [x.split("\t") for x in lines if x.startswith("L")]
    assert len(names) == built.unitigs.count() + built.dnodes.count() and len(links) == built.links().count()
    assert all({x[1], x[3]} <= names and x[5] == "3M" for x in links)
    xml = "".join(p.read_text() for p in sorted((tmp_path / "graphml").glob("part-*")))
    assert xml.startswith("<?xml") and xml.rstrip().endswith("</graphml>") and xml.count("<node ") == len(names)


def test_signatures_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", -1, 2), ("a", 5, 1), ("b", -(1 << 63), 3)], "name string, h long, abundance long")
    path = f"file://{tmp_path}/sig"
    out = signatures.minhash_signatures(rows, 21, 500)
    found = {r.name: json.loads(r.signature)["signatures"][0] for r in out.collect()}
    assert found["a"]["mins"] == [5, 2**64 - 1] and found["a"]["abundances"] == [1, 2] and found["b"]["mins"] == [2**63]
    signatures.write_signatures(out, path)
    assert _rows(signatures.read_minhash_signatures(spark, path).select("name", "h", "abundance")) == _rows(rows)
    sketches = spark.createDataFrame([("a", [1, 0, 7])], "name string, sketch array<long>")
    own = signatures.partition_signatures(sketches, 31, 9)
    signatures.write_signatures(own, f"{path}2")
    assert _rows(signatures.read_partition_signatures(spark, f"{path}2")) == _rows(own)


def test_saturation_stops_and_handlers(spark, tmp_path):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ACGT"), 300)) for _ in range(3)]
    seen = []
    handlers = Handlers()
    handlers.on_message(Message, lambda m: seen.append(type(m).__name__))
    handlers.on_message(DistanceCalc, lambda m: seen.append(m.distance))
    stream = runner.SaturationStream(k=21, n=50, cutoff=0.99, window=2, handlers=handlers)
    batch = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq_no long, sequence string")
    for i in range(6):
        stream.absorb(batch, i)
        stream.absorb(batch, i)
    assert stream.state == runner.STOP_SATURATED and SampleSaturated.__name__ in seen
    # the first similarity is of the second batch; windows of 2 fill by the fourth
    assert stream.last_batch == 3 and seen.count("DistanceCalc") == 3
    want = sketch.bottom(murmur_kmers(batch, 21), 50).collect()
    assert sorted(stream.mins) == sorted(r["h"] % (1 << 64) for r in want)


def test_stream_of_files(spark, tmp_path):
    schema = "seq_no long, sequence string"
    for i in range(3):
        spark.createDataFrame([(i, "ACGTTGCAAT" * 5)], schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    reads = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    stream = runner.SaturationStream(k=11, n=10, window=5)
    assert stream.run(reads, f"file://{tmp_path}/check") == runner.STOP and stream.sequences == 3
    runner.run_filter(reads, lambda df: df.where("seq_no > 0"), f"file://{tmp_path}/kept", f"file://{tmp_path}/check2").awaitTermination()
    assert _rows(spark.read.parquet(f"file://{tmp_path}/kept").select("seq_no")) == [(1,), (2,)]


def test_commands(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">0\nACGTTGCAATCCGATAG\n>1\nACGTTGCAATCCGATAG\n>2\nTTTTTTTTTTTTGGGGG\n")
    run = lambda *a: main([*a, "-i", f"file://{tmp_path}/a.fa", "-K", "11"], spark)
    run("sketch", "minhash", "-N", "5", "-o", f"file://{tmp_path}/sig")
    assert signatures.read_minhash_signatures(spark, f"file://{tmp_path}/sig").count() == 5
    run("filter", "solid", "-C", "2", "-P", "0.9", "-o", f"file://{tmp_path}/solid")
    assert [r.name for r in fastx.read_fastx(spark, f"file://{tmp_path}/solid/a").collect()] == ["1"]
    run("filter", "diginorm", "-C", "1", "-o", f"file://{tmp_path}/norm")
    assert sorted(r.name for r in fastx.read_fastx(spark, f"file://{tmp_path}/norm/a").select("name").collect()) == ["0", "2"]
    run("graph", "build", "--validate", "-o", f"file://{tmp_path}/g")
    run("utils", "hash-stream")
    with pytest.raises(SystemExit):
        main(["filter", "solid"], spark)


def test_windows_of_events(spark):
    rows = spark.sql("select timestamp_ntz'2020-01-01 00:10:00' as ts, 'a' as event_type, 1L as user_id, 2.0D as value union all select timestamp_ntz'2020-01-01 00:50:00', 'a', 1L, null")
    assert [(r.n, r.total) for r in runner.event_windows(rows).collect()] == [(2, 2.0)]
    assert runner.sessions(rows).count() == 2 and runner.sessions(rows, "1 hour").count() == 1
    assert runner.event_windows(rows.limit(0)).count() == 0
    assert runner.event_windows(rows, "1 hour", "30 minutes").agg(F.sum("n")).first()[0] == 4
