"""Hitting sets, saturation, incremental graphs, normalisation, records over several lines and stream plumbing, against plain loops."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.__main__ import main
from strandlake.functions.hashing import kmer_hash
from strandlake.kmers import kmers, packed_kmers
from strandlake.operators import filters, graph, hitting, saturation, sketch, stores, tags, windows
from strandlake.sources import fastx
from strandlake.streaming import messages, runner
from test_graphs import Plain, frame, tangle


@pytest.mark.parametrize("k", [2, 3, 4, 5, 6])
def test_decycling_set_is_least_and_hits_every_cycle(k):
    held = set(hitting.decycling_set(k))
    assert len(held) == hitting.n_rotation_classes(k)
    texts = [""]
    for _ in range(k):
        texts = [t + c for t in texts for c in "ACGT"]
    left = {t: [t[1:] + c for c in "ACGT" if t[1:] + c not in held] for t in texts if t not in held}
    into = {t: 0 for t in left}
    for near in left.values():
        for x in near:
            into[x] += 1
    free = [t for t in left if not into[t]]
    for t in free:
        for x in left[t]:
            into[x] -= 1
            if not into[x]:
                free.append(x)
    assert len(free) == len(left)  # what is left has no cycle


@pytest.mark.parametrize("canonical", [False, True])
def test_wmers(spark, tmp_path, canonical):
    value = lambda x: min(kmer_hash(x)) if canonical else kmer_hash(x)[0]
    listed = random.Random(1).sample(hitting.decycling_set(5), 60)
    (tmp_path / "set.txt").write_text("\n".join(listed) + "\n")
    hits = hitting.load_hitting_set(spark, f"file://{tmp_path}/set.txt", 5, canonical)
    order = {}
    for x in listed:
        order.setdefault(value(x), len(order))
    assert [(r.kmer, r.h % 2**64, r.partition) for r in hits.collect()] == [(x, value(x), order[value(x)]) for x in listed]
    sequences = tangle(3)
    want = {}
    for n, s in enumerate(sequences):
        for i in range(len(s) - 11):
            inner = [value(s[j : j + 5]) for j in range(i, i + 8)]
            least = min((h for h in inner if h in order), default=None)
            want[n, i] = (value(s[i : i + 12]), least, order.get(least))
    got = hitting.wmers(frame(spark, sequences), 12, 5, hits, canonical)
    assert {(r.seq_no, r.pos): (r.h % 2**64, None if r.minimizer is None else r.minimizer % 2**64, r.partition) for r in got.collect()} == want
    near = hitting.neighbour_wmers(spark.createDataFrame([(sequences[0][:12],)], "kmer string"), 12, 5, hits, "left", canonical).collect()
    assert {(r.symbol, r.h % 2**64) for r in near} == {(c, value(c + sequences[0][:11])) for c in "ACGT"}
    with pytest.raises(ValueError):
        hitting.hitting_set(spark, ["AC"], 5)


def test_partitioned_stores(spark):
    rows = spark.createDataFrame([(p, h) for p in range(3) for h in [7, 7, p, -p - 1]], "partition long, h long")
    asked = spark.createDataFrame([(p, h) for p in range(4) for h in (7, 0, -1, 99_991)], "partition long, h long")
    exact = {}
    for p in range(3):
        for h in [7, 7, p, -p - 1]:
            exact[p, h] = exact.get((p, h), 0) + 1
    for kind in stores.KINDS:
        made = stores.Partitioned.build(rows, stores.Shape(kind, 21, 100_000), 4)
        got = {(r.partition, r.h): r["count"] for r in made.query(asked).collect()}
        assert got == {(p, h): min(exact.get((p, h), 0), 1 if kind == "bloom" else 15) for p in range(4) for h in (7, 0, -1, 99_991)}
        assert [r.n_occupied for r in made.report().orderBy("partition").collect()] == [3, 3, 3, 0]
        assert made.totals().first().n_occupied == 9
    shape = stores.Shape.of_args("cms8", 21, 1e4)
    store = stores.Store.build(rows.select("h"), shape)
    assert (shape.probabilistic, shape.counting, store.empty().rows.count()) == (True, True, 0)
    assert store.n_occupied().first()[0] == 7 and 0 < store.estimated_fp().first()[0] < 1e-12
    assert stores.n_unique_estimate(spark.range(5000).select(F.xxhash64("id").alias("h")), 0.004).first()[0] == pytest.approx(5000, rel=0.008)


@pytest.mark.parametrize(("k", "canonical"), [(5, False), (7, True), (33, False)])
def test_graphs_take_in_more(spark, k, canonical, tmp_path):
    sequences = tangle(12)
    read = packed_kmers if k <= 31 else kmers
    made = graph.Compacted(graph.nodes(read(frame(spark, sequences[:3]), k)), k, canonical)
    for n in (6, 11):
        made = made.updated(graph.nodes(read(frame(spark, sequences[3 if n == 6 else 6 : n]), k)))
        made.save(f"file://{tmp_path}/{n}")
        made = graph.Compacted.load(spark, f"file://{tmp_path}/{n}")
        whole = graph.Compacted(graph.nodes(read(frame(spark, sequences[:n]), k)), k, canonical)
        for table in ("unitigs", "dnodes"):
            assert sorted(map(tuple, getattr(made, table).collect()), key=repr) == sorted(map(tuple, getattr(whole, table).collect()), key=repr)


def test_normalisation(spark):
    rng = random.Random(2)
    base = "".join(rng.choices("ACGT", k=60))
    reads = [(s, i, base[a : a + 25] if rng.random() < 0.8 else "".join(rng.choices("ACGT", k=25))) for s in ("a", "b") for i in range(60) for a in [rng.randrange(35)]]
    reads += [("a", 60, "ACG"), ("b", 60, None)]
    want = {}
    for sample in ("a", "b"):
        counts = {}
        for _, i, s in sorted((r for r in reads if r[0] == sample), key=lambda r: r[1]):
            own = [s[j : j + 9] for j in range(len(s) - 8)] if s else []
            ok = not own or sum(counts.get(x, 0) >= 3 for x in own) < int(0.5 + len(own) / 2)
            for x in own if ok else []:
                counts[x] = counts.get(x, 0) + 1
            want[sample, i] = (len(own), ok)
    df = spark.createDataFrame(reads, "sample string, seq_no long, sequence string")
    got = filters.digital_normalisation(df, 9, 3)
    assert {(r.sample, r.seq_no): (r.n_kmers, r.passed) for r in got.collect()} == want
    assert not all(ok for _, ok in want.values())
    last = filters.filter_metrics(got, 200).groupBy("sample").agg(F.max("t").alias("t")).collect()
    assert {r["sample"] for r in last} == {"a", "b"}


def test_running_counts_and_first_places(spark):
    rng = random.Random(3)
    rows = [(n, i, rng.choice("abc")) for n in range(40) for i in range(5)]
    df = spark.createDataFrame(rows, "seq_no long, pos long, kmer string")
    seen, want = {}, {}
    for n, i, x in rows:
        seen.setdefault(x, []).append((n, i))
        want[n, i] = len(seen[x])
    assert {(r.seq_no, r.pos): r["count"] for r in filters.running_counts(df, block=7).collect()} == want
    for m in (1, 3):
        assert {(r.kmer, r.seq_no, r.pos) for r in filters.first_places(df, m, block=7).collect()} == {(x, *p) for x, ps in seen.items() for p in ps[:m]}


def test_saturation(spark):
    rng = random.Random(4)
    base = "".join(rng.choices("ACGT", k=400))
    reads = [base[a : a + 60] for a in (rng.randrange(340) for _ in range(120))]
    rows = saturation.ticked(frame(spark, reads), 11, 250)
    curve = [(r.tick, r.distance) for r in saturation.minhash_curve(rows, 11, 40).orderBy("tick").collect()]
    from strandlake.functions.murmur import murmur64

    swap = str.maketrans("ACGT", "TGCA")
    h = lambda x: int(murmur64(np.frombuffer(min(x, x.translate(swap)[::-1]).encode(), np.uint8)[None])[0])
    held, want, before, t = set(), [], None, 0
    ticks = {}
    for n, s in enumerate(reads):
        ticks.setdefault(t // 250, []).append(n)
        t += 50
    for tick in sorted(ticks):
        held |= {h(s[i : i + 11]) for s in (reads[n] for n in ticks[tick]) for i in range(50)}
        now = set(sorted(held)[:40])
        if before is not None:
            want.append((tick, len(before & now) / len(now)))
        before = now
    assert curve == [(t, pytest.approx(d)) for t, d in want]
    decided = saturation.decided(spark.createDataFrame(curve, "tick long, distance double"), 2, 0.99)
    stop = decided.where("reached").agg(F.min("tick")).first()[0]
    assert stop is not None and saturation.saturated(rows, decided).count() == sum(len(v) for t, v in ticks.items() if t <= stop) < 120
    hits = hitting.hitting_set(spark, hitting.decycling_set(4), 4)
    drops = [r.distance for r in saturation.partition_curve(rows, 12, 4, hits).orderBy("tick").collect()]
    assert len(drops) == len(want) and drops[-1] < 1e-3 < drops[0]


def test_windows_without_one_task(spark):
    sizes = [random.Random(i).randrange(5) for i in range(50)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i long, n long")
    got = [(r.t, r.tick) for r in windows.floor_ticks(df, "i", "n", 7, block=8).orderBy("i").collect()]
    assert got == [(sum(sizes[: i + 1]), sum(sizes[: i + 1]) // 7) for i in range(50)]


def test_sketch_of_each_task(spark):
    h = [random.Random(i).randrange(-(2**62), 2**62) for i in range(300)] * 2
    df = spark.createDataFrame([(x,) for x in h], "h long").repartition(5)
    want = sorted({x % 2**64 for x in h})[:20]
    assert sorted((r.h % 2**64, r.abundance) for r in sketch.bottom(df, 20).collect()) == [(x, 2) for x in want]
    assert sketch.bottom(df.limit(0), 20).count() == 0


def test_tag_walks(spark):
    left = {1: 2, 2: 3, 3: 90, 4: 5, 5: 4, 6: 91, 7: 7}
    tag = spark.createDataFrame(list(left.items()), "key long, left long")
    got = tags.walks_to_tips(tag, spark.createDataFrame([(90,)], "key long"), spark.createDataFrame([(i,) for i in range(1, 9)], "key long"))
    assert {r.seed: (r.tip, r.end_state) for r in got.collect()} == {
        **{i: (90, "STOP_FWD") for i in (1, 2, 3)}, **{i: (None, "STOP_SEEN") for i in (4, 5, 7)}, 6: (None, "GRAPH_ERROR"), 8: (None, "BAD_SEED"),
    }


def test_fastq_over_several_lines(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 c\nACGT\nAC\n+\nIIII\n@I\n@r2\nGG\n+r2\n@@\n\n@r3\nAC\n+\nI\n")
    rows = fastx.scan_fastx(spark, f"file://{tmp_path}/a.fq", kind="wrapped").orderBy("seq_no").collect()
    assert [(r.name, r.comment, r.sequence, r.quality, r.status) for r in rows] == [("r1", "c", "ACGTAC", "IIII@I", "ok"), ("r2", None, "GG", "@@", "ok"), ("r3", None, "AC", "I", "format")]


def test_mates_of_unequal_files_are_an_error(spark, tmp_path):
    (tmp_path / "l.fa").write_text(">a/1\nAC\n>b/1\nGG\n")
    (tmp_path / "r.fa").write_text(">a/2\nAC\n")
    left, right = (fastx.scan_fastx(spark, f"file://{tmp_path}/{x}.fa", sample="s") for x in "lr")
    with pytest.raises(Exception, match="ends before"):
        fastx.paired(left, right).collect()
    assert fastx.paired(left, left).count() == 2


def test_stream_plumbing(spark, tmp_path):
    handlers, seen = messages.Handlers(), []
    messages.echo(handlers, str(tmp_path / "echo.json"))
    handlers.on_message(messages.Interval, messages.every_n(lambda m, x: seen.append((m.t, x)), 2), "x")
    handlers.on_message(messages.Interval, messages.at_ticks(lambda m: seen.append(m.sequence), [1, 3]))
    handlers.on_message(messages.EndStream, lambda m: 1 / 0)
    first, second = messages.Channel("a"), messages.Channel("b")
    first.forward(second)
    queue = second.subscribe("me")
    sent = [messages.Interval(sample_name="s", t=i, sequence=10 * i, seconds=0.5) for i in (1, 2, 3)] + [messages.EndStream(sample_name="s", t=3, sequence=30)]
    for m in sent:
        handlers.send(m)
        first.send(m)
    assert seen == [10, (2, "x"), 30] and list(queue) == sent and len(handlers.failures) == 1
    assert sent[1].rates(sent[0]) == (2, 20)
    assert [messages.Message.from_dict(json.loads(x)) for x in open(tmp_path / "echo.json")] == sent

    for n, s in enumerate(tangle(5)[:3]):
        frame(spark, [s]).coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
    stream = lambda: spark.readStream.schema("seq_no long, sequence string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    made, reports = runner.GraphStream(7), []
    made.callbacks.append(lambda g, i: reports.append(g.report().first().n_unique_kmers))
    runner.run_inserter(stream(), made, f"file://{tmp_path}/c1", handlers).awaitTermination()
    whole = Plain(tangle(5)[:3], 7)
    assert len(reports) == 3 and reports[-1] == len(whole.nodes)
    assert sorted(r.sequence for r in made.graph.unitigs.collect()) == sorted(set.union(*whole.unitigs()))
    passed = messages.Gauge("passed")
    runner.run_filter(stream(), lambda b: b.where(F.length("sequence") > 80), f"file://{tmp_path}/out", f"file://{tmp_path}/c2", passed).awaitTermination()
    assert passed.value == sum(len(s) > 80 for s in tangle(5)[:3])
    runner.json_sink(stream(), f"file://{tmp_path}/json", f"file://{tmp_path}/c3").awaitTermination()
    assert spark.read.json(f"file://{tmp_path}/json").count() == 3


def test_commands_with_reports(spark, tmp_path):
    rng = random.Random(6)
    base = "".join(rng.choices("ACGT", k=300))
    (tmp_path / "a.fa").write_text("".join(f">{i}\n{base[a : a + 60]}\n" for i, a in enumerate(rng.randrange(240) for _ in range(80))))
    url = f"file://{tmp_path}"
    run = lambda *a: main([*a, "-i", f"{url}/a.fa", "--interval", "300"], spark)
    run("sketch", "minhash", "-K", "11", "-N", "50", "--saturate", "--window-size", "2", "--distance-output", f"{url}/d", "--save-stream", f"{url}/s", "--save-every", "1", "-o", f"{url}/sig")
    assert spark.read.json(f"{url}/d/a").where("reached").count() > 0
    assert spark.read.text(f"{url}/sig").count() == 1 and spark.read.text(f"{url}/s/a").count() > 1
    run("sketch", "draff", "-K", "7", "-W", "15", "--distance-output", f"{url}/dd", "-o", f"{url}/draff")
    assert spark.read.json(f"{url}/draff").first()["size"] == hitting.n_rotation_classes(7)
    run("graph", "build", "-K", "11", "--canonical", "--normalize", "5", "--validate", f"{url}/v", "--track-metrics", f"{url}/m", "--track-components", f"{url}/mc", "--track-unitig-bp", f"{url}/mb", "--tick", "2", "-o", f"{url}/g")
    assert spark.read.json(f"{url}/v").first().n_missing == 0 and spark.read.json(f"{url}/m").count() >= 2
    run("filter", "diginorm", "-K", "11", "-C", "3", "--metrics", f"{url}/f", "-o", f"{url}/norm")
    assert 0 < spark.read.json(f"{url}/f/a").agg(F.max("p_seqs_passed")).first()[0] <= 1
    run("utils", "hash-stream", "-K", "11", "--graph", "--metrics", f"{url}/h")
    assert spark.read.json(f"{url}/h").first().t == 80 * 50
    with pytest.raises(SystemExit):
        run("graph", "build", "--tick", "x", "-o", f"{url}/x")
