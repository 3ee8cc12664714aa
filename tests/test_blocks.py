"""Block-encoded keys, stores and sketches built where reads are read, and what they shuffle."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import blocks
from strandlake.arrays import SLICE
from strandlake.blocks import counted_kmers
from strandlake.functions.hashing import hash_expression, packed_hash_expression, sequence_hashes
from strandlake.functions.md5 import window_md5
from strandlake.kmers import kmer_text, packed_kmers
from strandlake.operators import filters, hitting, sketch, stores, tags, windows
from strandlake.plans.registry import QUERIES
from test_graphs import frame


def h(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def reads_of(seed=5):
    r = random.Random(seed)
    core = "".join(r.choices("ACGT", k=300))
    own = ["".join(r.choices("ACGT", k=r.randrange(0, 90))) for _ in range(40)]
    return own + [core[i : i + 80] for i in range(0, 200, 9)] + ["A" * 60, "", "ACG", "ACGTNACGTACGTTTTACGTACG", core] * 2


def test_window_md5():
    data = np.frombuffer("".join(random.Random(1).choices("ACGT", k=300)).encode(), np.uint8)
    for k in (1, 4, 21, 31, 55):
        assert window_md5(data, k).tolist() == [h(data[i : i + k].tobytes().decode()) for i in range(300 - k + 1)]
    assert window_md5(data[:3], 4).tolist() == []
    with pytest.raises(ValueError):
        window_md5(data, 56)


@pytest.mark.parametrize("values", [[], [0], [0, 1, 255, 256, 2**40], [2**63 - 1, 0]])
def test_encoding(values):
    values = np.array(values, np.int64)
    assert blocks.decoded(blocks.encoded(values)).tolist() == values.tolist()
    ordered = np.sort(values).view(np.uint64)
    assert blocks.decoded_sorted(blocks.encoded_sorted(ordered)).tolist() == ordered.tolist()
    assert blocks.unmixed(blocks.mixed(values, 63), 63).tolist() == values.tolist()


@pytest.mark.parametrize(("k", "canonical", "least"), [(1, False, 1), (7, False, 1), (9, True, 2), (31, False, 1)])
def test_counted_kmers(spark, k, canonical, least):
    texts, want = reads_of(), Counter()
    for t in texts:
        for i in range(len(t) - k + 1):
            x = t[i : i + k]
            if "N" not in x:
                want[min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA"))) if canonical else x] += 1
    got = counted_kmers(frame(spark, texts), k, canonical, least, block=500, n_buckets=16).select(kmer_text(F.col("kmer"), k).alias("x"), "count").collect()
    assert {r.x: r["count"] for r in got} == {x: n for x, n in want.items() if n >= least} and len(got) == len({r.x for r in got})


def test_filters_of_whole_reads(spark, monkeypatch):
    """Chunks of a few reads and reads longer than a chunk, against plain loops."""
    monkeypatch.setattr(blocks, "BLOCK", 200)
    texts, k = reads_of(7), 9
    df = frame(spark, texts).repartition(5)
    places = {n: [(i, t[i : i + k]) for i in range(len(t) - k + 1) if "N" not in t[i : i + k]] for n, t in enumerate(texts)}
    total, seen, running = Counter(x for ps in places.values() for _, x in ps), Counter(), defaultdict(list)
    for n in sorted(places):
        for i, x in places[n]:
            seen[x] += 1
            running[n].append(seen[x])
    full = {n: ps for n, ps in places.items() if ps}

    def runs(flags):
        out = set()
        for n, ps in full.items():
            start = None
            for j, (i, _) in enumerate(ps):
                if flags(n, j):
                    start = i if start is None else start
                    if j + 1 == len(ps) or not flags(n, j + 1) or ps[j + 1][0] != i + 1:
                        out.add((n, start, i + 1))
                        start = None
        return out

    assert {r.seq_no: (r.counts, r.hashes) for r in filters.read_counts(df, k, True).withColumn("hashes", F.transform("hashes", lambda x: kmer_text(x, k))).collect()} == {
        n: ([total[x] for _, x in ps], [x for _, x in ps]) for n, ps in full.items()
    }
    assert {tuple(r) for r in filters.read_summaries(df, k).collect()} == {(n, len(c), max(c), c.count(1)) for n, c in running.items()}
    assert {tuple(r) for r in filters.solid_whole_reads(df, k, 3, 0.5).collect()} == {(n, len(c), low := sum(x < 3 for x in c), not low / len(c) >= 0.5) for n, c in running.items()}
    assert {tuple(r) for r in filters.reads_at_least(df, k, 2).collect()} == {(n, sum(total[x] >= 2 for _, x in ps) >= int(0.5 + len(ps) / 2)) for n, ps in full.items()}
    median = {n: sorted(total[x] for _, x in ps)[len(ps) // 2] for n, ps in full.items()}
    assert {tuple(r) for r in filters.read_medians(df, k, 1, 5).collect()} == {(n, m, 1 < m <= 5) for n, m in median.items()}
    assert {tuple(r) for r in filters.read_segments(df, k).collect()} == runs(lambda n, j: running[n][j] == 1)
    want = runs(lambda n, j: total[full[n][j][1]] >= 2)
    assert {tuple(r) for r in filters.read_segments(df, k, 2).collect()} == want
    assert {tuple(r) for r in filters.read_segments(df, k, 2, True).collect()} == {(n, a, texts[n][a : b + k - 1]) for n, a, b in want}


def test_summed_hashes(spark):
    """Weighted counts of any longs, and of nulls, in blocks."""
    r = random.Random(6)
    rows = [(r.choice([None, -1, 2**63 - 1, -(2**63), *range(300)]), r.randrange(1, 1000)) for _ in range(3000)]
    df, want = spark.createDataFrame(rows, "h long, n long").repartition(3), Counter()
    for x, n in rows:
        want[x] += n
    assert {x.h: x["count"] for x in blocks.summed_hashes(df, "h", "n", block=200, n_buckets=8).collect()} == want
    assert {x.h: x["count"] for x in blocks.summed_hashes(df, "h").collect()} == Counter(x for x, _ in rows)


def test_counts_of_an_ordered_pass():
    """A table of millions of keys takes each read in a time that does not grow with what it holds."""
    r, counts, want = np.random.default_rng(1), filters._Counts(), Counter()
    for _ in range(200):
        keys = r.integers(0, 3000, 60)
        assert counts.at_least(keys, 2) == sum(want[x] >= 2 for x in keys.tolist())
        counts.add(keys)
        want.update(keys.tolist())
    began, counts = time.perf_counter(), filters._Counts()
    for i in range(4000):
        counts.add(np.arange(1000 * i, 1000 * (i + 1)) * 7919)
    assert counts.at_least(np.arange(4_000_000) * 7919, 1) == counts.size == 4_000_000
    assert time.perf_counter() - began < 20


def test_sketches_of_groups(spark, monkeypatch):
    """The n least of each group, handed on in parts, with whole counts; a null group and null hashes."""
    monkeypatch.setattr(sketch, "HELD", 20)
    r = random.Random(3)
    rows = [(g, r.choice([x, x, -x])) for x in range(1, 80) for g in (1, 2, None, x % 7) for _ in range(r.randrange(3))] + [(1, None)]
    want = {}
    for g in {g for g, _ in rows}:
        n = Counter(x % 2**64 for y, x in rows if y == g and x is not None)
        want |= {(g, x): n[x] for x in sorted(n)[:5]}
    got = sketch.bottom(spark.createDataFrame(rows, "g int, h long").repartition(3), 5, "g").collect()
    assert {(x.g, x.h % 2**64): x.abundance for x in got} == want


def test_sketch_of_batches_without_news(spark):
    """Batches whose hashes are all too large change nothing."""
    df = spark.range(30_000).coalesce(1).select(F.col("id").alias("h"))
    assert sorted(tuple(r) for r in sketch.bottom(df, 3).collect()) == [(0, 1), (1, 1), (2, 1)]


def test_stores_of_reads(spark):
    """A store that is built where reads are read is that of their hashes, dense or by shuffles."""
    df, k = frame(spark, reads_of()), 9
    made = sketch.kmer_hashes(k)
    hashes = df.mapInArrow(made, "h long")
    rows = lambda x: {tuple(r) for r in x.collect()}
    for size in (200, 40_000_000):
        sizes = stores.table_sizes(size, 2)
        assert rows(stores.bloom(df, sizes, made=made)) == rows(stores.bloom(hashes, sizes)) == {(t, x.h % p) for x in hashes.collect() for t, p in enumerate(sizes)}
        want = Counter((t, x.h % p) for x in hashes.collect() for t, p in enumerate(sizes))
        assert rows(stores.count_min(df, sizes, 3, made=made)) == rows(stores.count_min(hashes, sizes, 3)) == {(*x, min(n, 3)) for x, n in want.items()}
    weighted = hashes.groupBy("h").agg(F.count("*").alias("n"))
    for size in (8, 20):
        want = Counter(x.h & ((1 << (size + 8)) - 1) for x in hashes.collect())
        assert rows(stores.quotient_counts(df, size, made=made)) == rows(stores.quotient_counts(weighted, size, weight="n")) == set(want.items())


@pytest.mark.parametrize("canonical", [False, True])
def test_minimizers_of_long_reads(spark, canonical):
    """Windows over the places at which a long read is cut, and reads shorter than a window."""
    w, k, r = 5, 7, random.Random(2)
    texts = ["".join(r.choices("ACGT", k=n)) for n in (0, 6, 10, 11, 12, 300)] + ["AC" * 30, "".join(r.choices("ACGT", k=SLICE + 500))]
    want = set()
    for n, t in enumerate(texts):
        fw, rc = sequence_hashes(np.frombuffer(t.encode(), np.uint8), k)
        value = np.minimum(fw, rc) if canonical else fw
        for i in range(len(value) - w + 1):
            if n < len(texts) - 1 or abs(i - SLICE) < 400:
                at = i + int(value[i : i + w].argmin())
                want.add((n, at, str(value[at]), t[at : at + k]))
    got = windows.kmer_minimizers(frame(spark, texts), w, k, canonical)
    last = len(texts) - 1
    rows = [tuple(x) for x in got.where(f"seq_no < {last} or abs(pos - {SLICE}) < 390").collect()]
    assert set(rows) == {x for x in want if x[0] < last or abs(x[1] - SLICE) < 390} and len(rows) == len(set(rows))


def test_tags_of_reads(spark):
    """Tags found where reads are read are those of windows over joined k-mers, also where a long read is cut."""
    r, k, w = random.Random(4), 4, 9
    texts = ["".join(r.choices("ACGT", k=n)) for n in (3, 8, 9, 10, 200)] + ["".join(r.choices("ACGT", k=SLICE + 300))]
    df = frame(spark, texts).repartition(3)
    hits = tags.hitting_set(tags.first_places(df, k).where(F.col("kmer") < 64))
    places = [(t[i : i + k], n, i) for n, t in enumerate(texts) for i in range(len(t) - k + 1) if t[i] == "A"]
    order = list(dict.fromkeys(x for x, _, _ in places))
    assert [x.t for x in hits.select(kmer_text(F.col("kmer"), k).alias("t"), "partition").orderBy("partition").collect()] == order
    near = lambda d: d.where(f"seq_no < 5 or abs(pos - {SLICE}) < 200")
    old = tags.tags(tags.window_minimizers(near(packed_kmers(df, k)), hits, w, k))
    inner = f"seq_no < 5 or abs(pos - {SLICE}) < 180"
    rows = lambda d: {tuple(x) for x in d.where(inner).collect()}
    assert rows(tags.tags_of_reads(df, hits, w, k)) == rows(old)


def test_partitions_of_reads(spark, monkeypatch):
    """Stores by partition and sketches, built where reads are read, against the w-mers' rows."""
    monkeypatch.setattr(blocks, "BLOCK", 300)
    df = frame(spark, reads_of(2)).withColumn("source", F.when(F.col("seq_no") % 5 > 0, F.col("seq_no") % 3))
    hits = hitting.hitting_set(spark, hitting.decycling_set(4), 4)
    n = hits.agg(F.max("partition") + 1).first()[0]
    made = hitting.wmer_kernel(df, 12, 4, hits, keep=("source",))
    rows = hitting.wmers(df, 12, 4, hits, keep=("source",)).where("partition is not null")
    got = lambda d: {tuple(map(str, x)) for x in d.collect()}
    for kind, size in (("exact", 99), ("bloom", 99), ("cms4", 99), ("cms4", 20_000_000)):
        shape = stores.Shape(kind, 12, size, 2)
        a, b = stores.Partitioned.build(df, shape, n, made), stores.Partitioned.build(rows, shape, n)
        assert got(a.query(rows)) == got(b.query(rows)) and got(a.report()) == got(b.report())
    assert got(stores.Partitioned.build(df, stores.Shape("exact", 12), n, made).own()) == got(rows.groupBy("partition", "h").count())
    assert got(sketch.partition_sketch_of(df, made, n, "source")) == got(sketch.partition_sketch(rows, n, "source"))


@pytest.mark.parametrize("k", [1, 4, 7, 27, 31])
def test_packed_hash_expression(spark, k):
    df = packed_kmers(frame(spark, reads_of()), k).select("kmer").distinct()
    assert df.where(packed_hash_expression(F.col("kmer"), k) != hash_expression(kmer_text(F.col("kmer"), k), k)).count() == 0


def shuffled(spark, df):
    """Bytes that a query shuffles and spills."""
    store, seen = spark._jsc.sc().statusStore(), spark._jvm
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(seen.double, 0), None)
    before = {(s.stageId(), s.attemptId()) for s in map(stages().apply, range(stages().size()))}
    df().write.format("noop").mode("overwrite").save()
    after = stages()
    new = [s for s in map(after.apply, range(after.size())) if (s.stageId(), s.attemptId()) not in before]
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() for s in new)


@pytest.fixture(scope="module")
def texts_dir(spark, tmp_path_factory):
    r, path = random.Random(9), str(tmp_path_factory.mktemp("texts"))
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(r.choices(words, k=700)), f"s{i % 3}", "en") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t, _, _ in rows[:3]], "item_id long, text string").coalesce(1).write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}", sum(len(t) - 700 for _, t, _, _ in rows)


#: Bytes a letter of the reads; all were above before their k-mers were shuffled in blocks or not at all.
LIMITS = {
    "bloom_query": 6, "bloom_occupancy": 6, "count_min_bytes": 30, "count_min_nibbles": 30, "count_min_big_counts": 30, "counting_minhash": 4, "sketch_operations": 4, "saturation_curve": 4, "ordered_store": 6,
    "masked_store": 6, "count_vectors": 8, "median_in_range": 8, "median_at_least": 8, "running_counts": 8, "solid_filter": 8, "solid_filter_of_four": 8, "new_segments": 8, "solid_segments": 8, "solid_segment_sequences": 8,
    "window_minimizers": 4, "minimizer_csv": 12, "partition_tags": 6, "partition_tag_links": 10, "partitioned_store": 12, "partitioned_graph": 15, "partition_signatures": 15, "signature_distances": 15,
}


@pytest.mark.parametrize("name", LIMITS)
def test_shuffle_of_queries(spark, texts_dir, name):
    path, letters = texts_dir
    assert shuffled(spark, lambda: QUERIES[name](spark, path)) < LIMITS[name] * letters
