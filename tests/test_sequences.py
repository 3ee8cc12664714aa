"""Sequence operators against pinned vectors and brute force."""

import functools
import operator
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import protein
from strandlake.functions.alphabet import ANY, DNA, IUPAC
from strandlake.functions.hashing import kmer_hash, max_hash_for_scaled, primes_near, sequence_hashes, unsigned_mod
from strandlake.kmers import kmers
from strandlake.operators import filters, graph, stores, windows
from strandlake.plans.registry import QUERIES


def frame(spark, sequences):
    return spark.createDataFrame(list(enumerate(sequences)), "seq_no long, sequence string")


def dna(seed, n):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def test_pinned_hash():
    assert kmer_hash("TCACCTGTGTTGTGCTACTTGCGGCGC") == (13194817695400542713, 4324216031038051805)


@pytest.mark.parametrize("k", [7, 27, 64, 101])
def test_rolling_equals_single(k):
    s = dna(k, 200)
    fw, rc = sequence_hashes(np.frombuffer(s.encode(), np.uint8), k)
    for i in (0, 1, 50, 200 - k):
        assert (int(fw[i]), int(rc[i])) == kmer_hash(s[i : i + k])


def test_sizes():
    assert primes_near(4, 10**6) == [999983, 999979, 999961, 999959]
    assert (max_hash_for_scaled(0), max_hash_for_scaled(1)) == (0, 2**64 - 1)


def test_unsigned_mod(spark):
    assert spark.range(1).select(unsigned_mod(F.lit(-1).cast("long"), 999983).alias("m")).first().m == (2**64 - 1) % 999983


def test_alphabets(spark):
    row = spark.createDataFrame([("acgtn",)], "s string").select(
        DNA.validate(F.col("s")).alias("a"), IUPAC.reverse_complement(F.upper("s")).alias("b"), ANY.reverse_complement(F.col("s")).alias("c")
    ).first()
    assert tuple(row) == (None, "NACGT", "acgtn")


def tables(spark, path, texts):
    """A folder of documents, and of a benchmark that must not stand in for them."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "dcbadcbadcbadcbadcbadcbadcbadcba")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_alphabets_of_whole_texts(spark, tmp_path):
    texts = ["acgt", "ACGT acgx", "acgtn!", "ACGT\n", "Stra\u00dfe", "", None]
    rows = QUERIES["alphabet_validation"](spark, tables(spark, tmp_path, texts)).orderBy("doc_id").collect()
    swap = str.maketrans("ATUGCYRSWKMBDHVN", "TAACGRYSWMKVHDBN")
    upper = [t and "".join(c.upper() if c.isascii() else c for c in t) for t in texts]
    valid = lambda symbols: [None if t is None else set(t) <= set(symbols) for t in upper]
    assert [r.dna for r in rows] == valid("ACGT")
    assert [r.dnan for r in rows] == valid("ACGTN")
    assert [r.iupac for r in rows] == valid("ATUGCYRSWKMBDHVN")
    assert [r["any"] for r in rows] == [t is not None for t in texts]
    assert [r.complement for r in rows] == [None if t is None else t.translate(swap) for t in upper]


def test_kmers_of_long_and_short_sequences(spark):
    sequences = [dna(1, 1000), "ACG", "", "ACGTA", None]
    got = {(r.seq_no, r.pos): r.kmer for r in kmers(frame(spark, sequences), 5).collect()}
    assert got == {(n, i): s[i : i + 5] for n, s in enumerate(sequences) if s for i in range(len(s) - 4)}


def test_solid_filter_needs_a_second_copy(spark):
    one = [dna(n, 59) for n in range(10)]
    single = filters.solid_reads(kmers(frame(spark, one), 31), 2, 0.9)
    assert single.where("passed").count() == 0
    double = filters.solid_reads(kmers(frame(spark, one + one), 31), 2, 0.9)
    assert sorted(r.seq_no for r in double.where("passed").collect()) == list(range(10, 20))


def test_interior_minimizer(spark):
    def run(values, w):
        df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
        return [r.min_value for r in windows.interior_minimizers(df, "v", "i", w).orderBy("i").collect()]

    assert run([3, 1, 2, 7, 8, 4, 6, 8], 3) == [1, 1, 2, 4, 4, 4]
    assert run([3, 2, 1, 2, 3], 5) == [1]
    assert run([1, 2], 5) == []


def test_sliding_mean_and_cutoff(spark):
    df = spark.createDataFrame([(i, float(i + 1), 10 * i) for i in range(5)], "i long, v double, t long")
    got = [r.m for r in df.select("i", windows.sliding(df, "v", "i", 3).alias("m")).orderBy("i").collect()]
    assert got == [None, None, 2, 3, 4]
    last = df.select("i", windows.sliding(df, "v", "i", 3, "normalized_mean", time="t").alias("m")).orderBy(F.desc("i")).first().m
    assert last == pytest.approx(4 / 20)
    fives = spark.createDataFrame([(i, 5.0) for i in range(6)], "i long, v double")
    reached = [r.reached for r in windows.sliding_cutoff(fives, "v", "i", 3, 2).orderBy("i").collect()]
    assert reached == [False] * 4 + [True] * 2


def test_interval_ticks_drop_the_remainder(spark):
    df = spark.createDataFrame([("s", i, 70) for i in range(10)], "sample string, i long, n long")
    got = [(r.i, r.tick, r.t) for r in windows.interval_ticks(df, "i", "n", 100, "sample").orderBy("i").collect()]
    assert got == [(1, 1, 140), (3, 2, 280), (5, 3, 420), (7, 4, 560), (9, 5, 700)]
    assert windows.fib_ticks(12) == [1, 2, 4, 7, 12]


def test_count_min_is_capped(spark):
    h = spark.range(40).select(F.lit(5).cast("long").alias("h"))
    sizes = stores.table_sizes(100, 3)
    assert stores.count_min_query(stores.count_min(h, sizes, 15), h, sizes).first()["count"] == 15
    assert stores.bloom_query(stores.bloom(h, sizes), spark.createDataFrame([(6,)], "h long"), sizes).first()["count"] == 0


def brute_graph(sequences, k):
    nodes = {s[i : i + k] for s in sequences for i in range(len(s) - k + 1)}
    out = {n: [n[1:] + c for c in "ACGT" if n[1:] + c in nodes] for n in nodes}
    into = {n: [c + n[:-1] for c in "ACGT" if c + n[:-1] in nodes] for n in nodes}
    decisions = {n for n in nodes if len(out[n]) > 1 or len(into[n]) > 1}
    unitigs, used = set(), set()
    for n in nodes - decisions:
        if [p for p in into[n] if p not in decisions]:
            continue
        text, at = n, n
        used.add(n)
        while (near := [x for x in out[at] if x not in decisions]):
            at = near[0]
            used.add(at)
            text += at[-1]
        unitigs.add(text)
    return nodes, decisions, unitigs, nodes - decisions - used


def test_compaction(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("ACGT") for _ in range(150))
    cycle = "".join(rng.choice("ACGT") for _ in range(40))
    sequences = [base, base[:70] + "".join(rng.choice("ACGT") for _ in range(50)), cycle + cycle[:12]]
    made = graph.Compacted(graph.nodes(kmers(frame(spark, sequences), 11)), 11)
    nodes, decisions, unitigs, circular = brute_graph(sequences, 11)
    assert {r.kmer for r in made.dnodes.collect()} == decisions
    rows = made.unitigs.collect()
    assert {r.sequence for r in rows if r.meta != "CIRCULAR"} == unitigs
    rings = [r for r in rows if r.meta == "CIRCULAR"]
    assert len(rings) == 1 and {rings[0].sequence[i : i + 11] for i in range(rings[0].length - 10)} == circular
    assert tuple(made.validate().first()) == (len(nodes), len(nodes), 0, 0, 0)
    assert made.components().select("component").distinct().count() == 2


def test_sequence_queries_read_the_documents(spark, tmp_path):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    base = word(1500)
    texts = [base, base[:700] + " " + word(60), word(70), word(40), "", "ab", None]
    sf_dir = tables(spark, tmp_path, texts)
    run = lambda name: QUERIES[name](spark, sf_dir).collect()
    seqs = {i: t.replace(" ", "").translate(str.maketrans("abcd", "ACGT")) for i, t in enumerate(texts) if t is not None}
    kms = lambda k: [(i, p, s[p : p + k]) for i, s in seqs.items() for p in range(len(s) - k + 1)]

    xor = lambda xs: str(functools.reduce(operator.xor, xs))
    per_read = {}
    for i, _, x in kms(27):
        per_read.setdefault(i, []).append(kmer_hash(x))
    got = {r.seq_no: (r.n, r.least_fw, r.most_rc, r.least_h, r.all_fw, r.all_rc, r.all_h, r.n_forward) for r in run("cyclic_hashes")}
    assert got == {i: (len(h), str(min(f for f, _ in h)), str(max(r for _, r in h)), str(min(map(min, h))), xor(f for f, _ in h), xor(r for _, r in h), xor(map(min, h)), sum(f < r for f, r in h)) for i, h in per_read.items()}
    assert {tuple(r) for r in run("cyclic_hash_expression")} == {(i, len(h), xor(f for f, _ in h)) for i, h in per_read.items()}

    nodes, decisions, unitigs, circular = brute_graph(list(seqs.values()), 15)
    assert decisions and not circular
    edges = {(n, n[1:] + c) for n in nodes for c in "ACGT" if n[1:] + c in nodes}
    pairs = sorted(edges)
    assert tuple(run("graph_edges")[0]) == (len(edges), len({a for a, _ in edges}), len({b for _, b in edges}), "".join(pairs[0]), "".join(pairs[-1]))
    assert sorted(r.sequence for r in run("graph_unitigs")) == sorted(unitigs)
    assert tuple(run("graph_validation")[0]) == (len(nodes), len(nodes), 0, 0, 0)
    kinds = {r.meta: r.n for r in run("graph_unitig_kinds")}
    assert kinds.pop("DECISION") == len(decisions) and sum(kinds.values()) == len(unitigs)
    group = {n: n for n in nodes}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in edges:
        group[root(a)] = root(b)
    parts = [*decisions, *(u[:15] for u in unitigs)]
    assert sorted(r["size"] for r in run("graph_components")) == sorted(sum(root(p) == r for p in parts) for r in {root(p) for p in parts})
    lines = [r.value.split("\t") for r in run("graph_gfa")]
    assert sorted(x[2] for x in lines if x[0] == "S") == sorted([*unitigs, *decisions])

    first = {}
    for _, _, x in sorted(kms(7)):
        if x.startswith("A"):
            first.setdefault(x, len(first))
    tag = []
    for i, s in seqs.items():
        least = [min((s[q : q + 7] for q in range(p, p + 14) if s[q : q + 7] in first), default=None) for p in range(len(s) - 19)]
        tag += [(i, p, first[x], first[y]) for p, (x, y) in enumerate(zip(least, least[1:], strict=False)) if x and y and x != y]
    assert sorted(map(tuple, run("partition_tags"))) == sorted(tag)
    links = {(x, y, len({t[0] for t in tag if t[2:] == (x, y)}), sum(t[2:] == (x, y) for t in tag)) for _, _, x, y in tag}
    assert {tuple(r) for r in run("partition_tag_links")} == links

    code = dict(zip((a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"), protein.RESIDUES, strict=True))
    residues = {i: "".join(code[s[p : p + 3]] for p in range(0, len(s) - 2, 3)) for i, s in seqs.items()} | {6: None}
    assert {r.seq_no: r.residues for r in run("codon_translation")} == residues


def test_unitigs_hold_cycles(spark, tmp_path):
    rng = random.Random(5)
    line, ring, short = ("".join(rng.choice("abcd") for _ in range(n)) for n in (200, 40, 6))
    texts = [line, ring * 3, short * 9, "a" * 30, "ab" * 20]
    got = sorted(r.sequence for r in QUERIES["graph_unitigs"](spark, tables(spark, tmp_path, texts)).collect())
    seqs = [t.translate(str.maketrans("abcd", "ACGT")) for t in texts]
    nodes, decisions, unitigs, rest = brute_graph(seqs, 15)
    assert not decisions
    want = sorted(unitigs)
    while rest:
        text = at = min(rest)
        while at in rest:
            rest.remove(at)
            near = [at[1:] + c for c in "ACGT" if at[1:] + c in nodes]
            at = near[0]
            text += at[-1] if at in rest else ""
        want.append(text)
    assert len(want) == 5 and got == sorted(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).first().n_kmers > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
