"""Compaction, walks and edits of graphs on one strand and both, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import arrays
from strandlake.kmers import kmer_key, kmer_text, kmers, packed_kmers, reverse_key
from strandlake.operators import chains, graph

SWAP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(SWAP)[::-1]


def frame(spark, sequences):
    return spark.createDataFrame(list(enumerate(sequences)), "seq_no long, sequence string")


class Plain:
    """The same graph, step by step."""

    def __init__(self, sequences, k, canonical=False, mask=()):
        self.k, self.canonical = k, canonical
        self.nodes = {s[i : i + k] for s in sequences for i in range(len(s) - k + 1)}
        gone = set(mask)
        if canonical:
            self.nodes |= {rc(n) for n in self.nodes}
            gone |= {rc(n) for n in gone}
        self.nodes -= gone
        self.out = {n: [n[1:] + c for c in "ACGT" if n[1:] + c in self.nodes] for n in self.nodes}
        self.into = {n: [c + n[:-1] for c in "ACGT" if c + n[:-1] in self.nodes] for n in self.nodes}
        self.decisions = {n for n in self.nodes if len(self.out[n]) > 1 or len(self.into[n]) > 1}

    def unitigs(self):
        found, used = set(), set()
        plain = sorted(self.nodes - self.decisions)
        for n in plain:
            if all(p in self.decisions for p in self.into[n]):
                text = at = n
                used.add(n)
                while near := [x for x in self.out[at] if x not in self.decisions]:
                    at = near[0]
                    used.add(at)
                    text += at[-1]
                found.add(min(text, rc(text)) if self.canonical else text)
        rings = {}
        for n in plain:
            if n not in used:
                ring = [n]
                while (at := self.out[ring[-1]][0]) != n:
                    ring.append(at)
                used |= set(ring)
                text = n + "".join(x[-1] for x in ring[1:])
                key = min(min(x, rc(x)) for x in ring) if self.canonical else n
                rings[key] = min(rings.get(key, text), text)
        return found, set(rings.values())

    def walk(self, seed, right=True, stop=()):
        if seed not in self.nodes:
            return seed, "BAD_SEED"
        ahead, back = (self.out, self.into) if right else (self.into, self.out)
        path, text = [seed], seed
        while True:
            near = ahead[path[-1]]
            if len(near) != 1:
                return text, "DECISION_FWD" if near else "STOP_FWD"
            n = near[0]
            if n in path:
                return text, "STOP_SEEN"
            if n in stop:
                return text, "STOP_MASKED"
            if len(back[n]) > 1:
                return text, "DECISION_BKW"
            path.append(n)
            text = text + n[-1] if right else n[0] + text


def tangle(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    base, ring = word(90), word(25)
    return [base, base[:40] + word(30), word(20) + base[60:], ring * 3, "A" * 12, "AC" * 9, rc(base)[:30] + word(15), word(8), word(3), "", base[10:30] * 3]


@pytest.mark.parametrize(("k", "canonical", "seed"), [(5, False, 1), (5, True, 2), (7, True, 3), (9, False, 4), (33, False, 5), (33, True, 6), (4, True, 7)])
def test_compaction_and_walks(spark, k, canonical, seed, monkeypatch):
    monkeypatch.setattr(chains, "BLOCK", 40)
    sequences = tangle(seed)
    want = Plain(sequences, k, canonical)
    made = graph.Compacted(graph.nodes((packed_kmers if k <= 31 else kmers)(frame(spark, sequences), k)), k, canonical)
    listed = {min(d, rc(d)) for d in want.decisions} if canonical else want.decisions
    assert {(r.kmer, r.left_degree, r.right_degree) for r in made.dnodes.collect()} == {(d, len(want.into[d]), len(want.out[d])) for d in listed}
    lines, rings = want.unitigs()
    rows = made.unitigs.collect()
    assert sorted(r.sequence for r in rows if not r.circular) == sorted(lines)
    assert sorted(r.sequence for r in rows if r.circular) == sorted(rings)
    name = lambda d: min(d, rc(d)) if canonical else d
    for r in rows:
        beside = [[name(d) for d in near if d in want.decisions] for near in (want.into[r.left_end], want.out[r.right_end])]
        assert [r.left_dnode, r.right_dnode] == [b[0] if b and not r.circular else None for b in beside]
    check = made.validate().first()
    n = len({min(x, rc(x)) for x in want.nodes}) if canonical else len(want.nodes)
    assert (check.n_nodes, check.n_missing, check.n_foreign) == (n, 0, 0)
    rng = random.Random(seed)
    seeds = sorted({*rng.sample(sorted(want.nodes), min(60, len(want.nodes))), *list(want.decisions)[:30], "G" * k})
    stops = rng.sample(sorted(want.nodes), min(12, len(want.nodes)))
    table = spark.createDataFrame([(s,) for s in seeds], "kmer string")
    held = spark.createDataFrame([(s,) for s in stops], "kmer string")
    for side in ("right", "left"):
        got = {r.seed: (r.sequence, r.end_state) for r in made.walks(table, side).collect()}
        assert got == {s: want.walk(s, side == "right") for s in seeds}
        got = {r.seed: (r.sequence, r.end_state) for r in made.walks(table, side, held).collect()}
        assert got == {s: want.walk(s, side == "right", stops) for s in seeds}
    found = {r.kmer: r for r in made.find(table).collect()}
    assert set(found) == {s for s in seeds if s in want.nodes}


def test_masked_graph(spark):
    sequences = tangle(8)
    mask = Plain(sequences, 5).decisions
    want = Plain(sequences, 5, mask=mask)
    made = graph.Compacted(graph.nodes(packed_kmers(frame(spark, sequences), 5)), 5, mask=spark.createDataFrame([(m,) for m in mask], "kmer string"))
    lines, rings = want.unitigs()
    assert sorted(r.sequence for r in made.unitigs.collect()) == sorted(lines | rings)


def test_components_links_and_reach(spark):
    for canonical in (False, True):
        sequences = tangle(9)
        made = graph.Compacted(graph.nodes(packed_kmers(frame(spark, sequences), 7)), 7, canonical)
        want = Plain(sequences, 7, canonical)
        names = {}
        for r in made.unitigs.collect():
            for i in range(len(r.sequence) - 6):
                names[r.sequence[i : i + 7]] = names[rc(r.sequence[i : i + 7]) if canonical else r.sequence[i : i + 7]] = "u:" + r.left_end
        for d in want.decisions:
            names[d] = "d:" + (min(d, rc(d)) if canonical else d)
        links = {(names[a], names[b]) for a in want.nodes for b in want.out[a] if names[a] != names[b] or a in want.decisions}
        got = {tuple(r) for r in made.links().collect()}
        assert {x for x in got if x[0] != x[1]} == {x for x in links if x[0] != x[1]}
        group = {n: n for n in names.values()}

        def root(x):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in links:
            group[root(a)] = root(b)
        parts = {}
        for x in group:
            parts.setdefault(root(x), set()).add(x)
        stats = made.component_stats().first()
        assert tuple(stats) == (len(parts), max(map(len, parts.values())), min(map(len, parts.values())))
        some = sorted(group)[:3]
        got = {}
        for r in made.reach(spark.createDataFrame([(x,) for x in some], "node string")).collect():
            got.setdefault(r.root, set()).add(r.node)
        assert got == {x: parts[root(x)] for x in some}
        report = made.report().first()
        assert report.n_dnodes == made.dnodes.count() and report.n_unodes == made.unitigs.count()
    twins = graph.Compacted(graph.nodes(packed_kmers(frame(spark, ["ACCGTT", "AACGGT"]), 6)), 6).twins()
    assert {tuple(r) for r in twins.collect()} == {("u:ACCGTT", "u:AACGGT"), ("u:AACGGT", "u:ACCGTT")}


def test_edges_and_degrees(spark):
    for k, read in ((6, packed_kmers), (6, kmers)):
        want = Plain(tangle(10), k)
        node = graph.nodes(read(frame(spark, tangle(10)), k))
        text = lambda c: kmer_text(F.col(c), k) if read is packed_kmers else F.col(c)
        assert {tuple(r) for r in graph.edges(node, k).select(text("src"), text("dst")).collect()} == {(a, b) for a in want.nodes for b in want.out[a]}
        got = {r[0]: (r[1], r[2]) for r in graph.degrees(node, k).select(text("kmer"), "left_degree", "right_degree").collect()}
        assert got == {n: (len(want.into[n]), len(want.out[n])) for n in want.nodes}
        near = graph.neighbours(node, node, k, "left").select(text("kmer"), "symbol", text("neighbour"))
        assert {tuple(r) for r in near.collect()} == {(n, x[0], x) for n in want.nodes for x in want.into[n]}


@pytest.mark.parametrize("k", [1, 2, 15, 31])
def test_packed_forms(spark, k):
    texts = ["".join(random.Random(n).choices("ACGT", k=k)) for n in range(50)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", kmer_key(F.col("t")))
    for r in rows.select("t", kmer_text(F.col("p"), k).alias("back"), kmer_text(reverse_key(F.col("p"), k), k).alias("rc")).collect():
        assert (r.back, r.rc) == (r.t, rc(r.t))


def test_slices_hold_every_window_once():
    rows = ["".join(random.Random(n).choices("ACGT", k=n)) for n in (30, 0, 200, 5, 7, 49, 50, 51, 99)]
    data, at = np.frombuffer("".join(rows).encode(), np.uint8), np.cumsum([0, *map(len, rows)])
    got = []
    for own, places, piece, offset in arrays.slices(data, at, 6, 50):
        start, row = arrays.window_starts(places, 7)
        got += [(piece[r], s - places[r] + offset[r], own[s : s + 7].tobytes().decode()) for s, r in zip(start, row)]
    assert sorted(got) == [(n, i, s[i : i + 7]) for n, s in enumerate(rows) for i in range(len(s) - 6)]


def test_packed_kmers_leave_other_symbols_out(spark):
    sequences = ["ACGTNACGTA", "NN", "", None, "A" * 5, "".join(random.Random(1).choices("ACGTN", k=400, weights=[9, 9, 9, 9, 1]))]
    got = {(r.seq_no, r.pos): r.t for r in packed_kmers(frame(spark, sequences), 5).select("seq_no", "pos", kmer_text(F.col("kmer"), 5).alias("t")).collect()}
    assert got == {(n, i): s[i : i + 5] for n, s in enumerate(sequences) if s for i in range(len(s) - 4) if "N" not in s[i : i + 5]}
    both = packed_kmers(frame(spark, sequences), 5, canonical=True).select("seq_no", "pos", kmer_text(F.col("kmer"), 5).alias("t"))
    assert {(r.seq_no, r.pos): r.t for r in both.collect()} == {k: min(v, rc(v)) for k, v in got.items()}


def test_edits_of_nodes(spark):
    s, k = "ACGGTCATTGCA", 5
    one = spark.createDataFrame([(1, s, 3, False, s[-4:] + "TT", "GG" + s[:4]), (2, "ACGGT", 0, False, "CGGTA", "TACGG")], "node_id long, sequence string, at int, circular boolean, right string, left string")
    assert {tuple(r) for r in graph.clipped(one, k).collect()} == {(1, s[1:])}
    assert {tuple(r) for r in graph.clipped(one, k, "right").collect()} == {(1, s[:-1])}
    assert {tuple(r) for r in graph.extended(one, k, "right", "right").collect()} == {(1, s + "TT"), (2, "ACGGTA")}
    assert {tuple(r) for r in graph.extended(one, k, "left", "left").collect()} == {(1, "GG" + s), (2, "TACGGT")}
    with pytest.raises(Exception, match="no overlap"):
        graph.extended(one, k, "right", "left").collect()
    assert {tuple(r) for r in graph.split(one, k).collect()} == {(1, 0, s[:7]), (1, 1, s[4:])}
    assert {tuple(r) for r in graph.flipped(one).collect()} == {(1, rc(s)), (2, "ACCGT")}
    ring = "ACGGTCATTG"
    rows = spark.createDataFrame([(1, ring + ring[:4], 3, True)], "node_id long, sequence string, at int, circular boolean")
    (got,) = graph.split(rows, k).collect()
    left = {(ring + ring[:4])[i : i + k] for i in range(10)} - {(ring + ring[:4])[3 : 3 + k]}
    assert {got.sequence[i : i + k] for i in range(len(got.sequence) - k + 1)} == left
    pairs = spark.createDataFrame([("ACGGT", "CGGTCATT", "CATTG"), ("ACGGTC", "GGTCACGG", "ACGGTC")], "left string, span string, right string")
    assert [tuple(r) for r in graph.merged(pairs, k).collect()] == [("ACGGTCATTG", False), ("ACGGTCACGG", True)]
