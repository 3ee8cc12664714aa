"""De Bruijn graphs of k-mers and their compaction, on one strand or both.

Nodes are distinct k-mers; an edge joins two whose k-1 overlap.  A decision node
has more than one neighbour on a side.  Unitigs are the maximal chains of other
nodes.  K-mers of up to 31 symbols are packed into longs.

Neighbours come from one aggregation by overlap: a k-1 overlap tells which
k-mers end and which begin with it, four of each at most, so degrees and edges
need no join.  Chains are first joined within blocks of k-mers that share a
minimizer, then between blocks by pointer jumping in a logarithmic number of rounds.

A graph of both strands holds each k-mer and its reverse complement; what is
found twice, once on each strand, is listed once, as the lesser of the two.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.kmers import SYMBOLS, Codec, kmers, packed_kmers
from strandlake.operators.chains import chain_batches
from strandlake.tables import Relay, ship_package, stored

#: Length of the minimizers that deal k-mers to blocks; it decides only how much is joined early.
MINIMIZER = 7


def nodes(kmers: DataFrame) -> DataFrame:
    """(kmer, count) of distinct k-mers."""
    return kmers.groupBy("kmer").agg(F.count("*").alias("count"))


def _codec(node: DataFrame, k: int) -> Codec:
    return Codec(k, dict(node.dtypes)["kmer"] == "bigint")


def both_strands(node: DataFrame, k: int) -> DataFrame:
    """The nodes and their reverse complements, with the counts of both together."""
    codec = _codec(node, k)
    other = node.select(codec.reverse(F.col("kmer")).alias("kmer"), F.when(codec.reverse(F.col("kmer")) != F.col("kmer"), F.col("count")).otherwise(0).cast("long").alias("count"))
    return node.select("kmer", F.col("count").cast("long").alias("count")).unionByName(other).groupBy("kmer").agg(F.sum("count").alias("count"))


def overlaps(node: DataFrame, k: int) -> DataFrame:
    """(overlap, n0..n3, after): counts of the k-mers that end with an overlap, by first symbol, and a bit for each that begins with it."""
    codec, c = _codec(node, k), F.col("kmer")
    ends = F.struct(codec.suffix(c).alias("overlap"), codec.first(c).alias("before"), F.lit(None).cast("int").alias("after"), F.col("count"))
    begins = F.struct(codec.prefix(c).alias("overlap"), F.lit(None).cast("int").alias("before"), codec.last(c).alias("after"), F.lit(None).cast("long").alias("count"))
    rows = node.select(F.explode(F.array(ends, begins)).alias("x")).select("x.*")
    before = [F.max(F.when(F.col("before") == i, F.col("count"))).alias(f"n{i}") for i in range(4)]
    bits = F.coalesce(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("after"))), F.lit(0)).alias("after")
    return rows.groupBy("overlap").agg(*before, bits)


def _members(codec: Codec, side: str) -> list[tuple[Column, Column]]:
    """(whether it exists, the k-mer) of the four k-mers that end (``before``) or begin with an overlap."""
    if side == "before":
        return [(F.col(f"n{i}").isNotNull(), codec.before(i, F.col("overlap"))) for i in range(4)]
    return [(F.col("after").bitwiseAND(F.lit(1 << i)) != 0, codec.after(F.col("overlap"), i)) for i in range(4)]


def edges(node: DataFrame, k: int) -> DataFrame:
    """(src, dst): src's last k-1 symbols are dst's first."""
    codec = _codec(node, k)
    pairs = [F.when(a & b, F.struct(x.alias("src"), y.alias("dst"))) for a, x in _members(codec, "before") for b, y in _members(codec, "after")]
    both = overlaps(node, k).where("after <> 0 and coalesce(n0, n1, n2, n3) is not null")
    return both.select(F.explode(F.array_compact(F.array(*pairs))).alias("e")).select("e.src", "e.dst")


def degrees(node: DataFrame, k: int) -> DataFrame:
    """(kmer, count, left_degree, right_degree): half of each from the overlap before it, half from the one after."""
    codec = _codec(node, k)
    none = F.lit(None).cast("long")
    n_before = sum((F.col(f"n{i}").isNotNull().cast("long") for i in range(4)), F.lit(0).cast("long"))
    n_after = F.bit_count("after").cast("long")
    ends = [F.when(a, F.struct(x.alias("kmer"), F.col(f"n{i}").alias("count"), none.alias("left"), n_after.alias("right"))) for i, (a, x) in enumerate(_members(codec, "before"))]
    begins = [F.when(b, F.struct(y.alias("kmer"), none.alias("count"), n_before.alias("left"), none.alias("right"))) for b, y in _members(codec, "after")]
    halves = overlaps(node, k).select(F.explode(F.array_compact(F.array(*ends, *begins))).alias("x")).select("x.*")
    return halves.groupBy("kmer").agg(F.max("count").alias("count"), F.max("left").alias("left_degree"), F.max("right").alias("right_degree"))


def decision_nodes(node: DataFrame, k: int) -> DataFrame:
    return degrees(node, k).where("left_degree > 1 or right_degree > 1")


def neighbours(node: DataFrame, seeds: DataFrame, k: int, side: str = "right") -> DataFrame:
    """(kmer, symbol, neighbour) of seeds, where the neighbour is in the graph."""
    codec, c = _codec(node, k), F.col("kmer")
    make = (lambda i: codec.after(codec.suffix(c), i)) if side == "right" else (lambda i: codec.before(i, codec.prefix(c)))
    near = seeds.select(c, F.explode(F.array(*[F.struct(F.lit(SYMBOLS[i]).alias("symbol"), make(i).alias("neighbour")) for i in range(4)])).alias("x"))
    near = near.select("kmer", "x.symbol", "x.neighbour")
    return near.join(node.select(F.col("kmer").alias("neighbour")), "neighbour", "left_semi").select("kmer", "symbol", "neighbour")


class Compacted:
    """Unitigs and decision nodes of a k-mer set.

    nodes: distinct k-mers (text or packed) with their counts.  mask: k-mers taken
    out of the graph first.  canonical: the graph of both strands.

    unitigs: node_id, sequence, length, left_end, right_end, meta, left_dnode, right_dnode.
    dnodes: kmer, count, left_degree, right_degree.  K-mers of both are texts.
    """

    def __init__(self, node: DataFrame, k: int, canonical: bool = False, mask: DataFrame | None = None):
        self.k, self.canonical, self.codec = k, canonical, Codec(k)
        if dict(node.dtypes)["kmer"] == "string":
            node = node.select(self.codec.key(F.col("kmer")).alias("kmer"), "count")
        if mask is not None:
            gone = mask.select(self._key(mask).alias("kmer"))
            if canonical:
                gone = gone.unionByName(gone.select(self.codec.reverse(F.col("kmer")).alias("kmer")))
            node = node.join(gone.distinct(), "kmer", "left_anti")
        node = node.select("kmer", F.col("count").cast("long").alias("count"))
        self.packed_nodes = stored(both_strands(node, k) if canonical else node, "nodes")
        self._set_degrees(stored(degrees(self.packed_nodes, k), "degrees"))
        plain = self.degrees.where("left_degree <= 1 and right_degree <= 1").select("kmer")
        self.unitigs = stored(self._classified(self._unitigs(plain)), "unitigs")

    def _set_degrees(self, degree: DataFrame) -> None:
        self.degrees = degree
        self._decisions = self.degrees.where("left_degree > 1 or right_degree > 1")
        text = self.codec.text(F.col("kmer")).alias("kmer")
        once = self._decisions.where(F.col("kmer") <= self.codec.reverse(F.col("kmer"))) if self.canonical else self._decisions
        self.dnodes = once.select(text, "count", "left_degree", "right_degree")

    @classmethod
    def _of(cls, k: int, canonical: bool, node: DataFrame, degree: DataFrame, unitigs: DataFrame) -> Compacted:
        """A graph from its tables."""
        made = cls.__new__(cls)
        made.k, made.canonical, made.codec = k, canonical, Codec(k)
        made.packed_nodes, made.unitigs = node, unitigs
        made._set_degrees(degree)
        return made

    def save(self, path: str) -> None:
        """Three Parquet tables, and one line of JSON that is written last."""
        for name, df in (("nodes", self.packed_nodes), ("degrees", self.degrees), ("unitigs", self.unitigs)):
            df.write.parquet(f"{path}/{name}")
        spark = self.unitigs.sparkSession
        spark.createDataFrame([(json.dumps({"k": self.k, "canonical": self.canonical}),)], "value string").write.text(f"{path}/shape")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Compacted:
        shape = json.loads(spark.read.text(f"{path}/shape").first()[0])
        return cls._of(shape["k"], shape["canonical"], *[spark.read.parquet(f"{path}/{name}") for name in ("nodes", "degrees", "unitigs")])

    def updated(self, more: DataFrame) -> Compacted:
        """The graph with further nodes (kmer, count), of which only what they touch is compacted anew.

        Degrees change for k-mers that share an overlap with a new one.  Unitigs
        without such a k-mer stay as they are: what ends them stays a decision.
        """
        codec, k, c = self.codec, self.k, F.col("kmer")
        more = more.select(self._key(more).alias("kmer"), F.col("count").cast("long").alias("count"))
        more = stored(both_strands(more, k) if self.canonical else more.groupBy("kmer").agg(F.sum("count").alias("count")), "more")
        node = stored(self.packed_nodes.unionByName(more).groupBy("kmer").agg(F.sum("count").alias("count")), "nodes")
        fresh = stored(more.join(self.packed_nodes.select("kmer"), "kmer", "left_anti").select("kmer"), "fresh")
        near = fresh.select(F.explode(F.array(F.struct(F.lit(0).alias("e"), codec.prefix(c).alias("o")), F.struct(F.lit(1).alias("e"), codec.suffix(c).alias("o")))).alias("x")).select("x.o").distinct()
        sides = node.select("kmer", F.explode(F.array(codec.prefix(c), codec.suffix(c))).alias("o"))
        changed = stored(sides.join(near, "o", "left_semi").select("kmer").distinct(), "changed")
        # degrees of the changed need all that shares an overlap with them
        around = changed.select(F.explode(F.array(codec.prefix(c), codec.suffix(c))).alias("o")).distinct()
        part = node.join(sides.join(around, "o", "left_semi").select("kmer").distinct(), "kmer", "left_semi")
        new = degrees(part, k).join(changed, "kmer", "left_semi").drop("count").join(node, "kmer").select("kmer", "count", "left_degree", "right_degree")
        old = self.degrees.join(changed, "kmer", "left_anti").drop("count").join(node, "kmer").select("kmer", "count", "left_degree", "right_degree")
        made = self._of(k, self.canonical, node, stored(old.unionByName(new), "degrees"), self.unitigs)
        # unitigs with a changed k-mer are opened
        listed = (packed_kmers if codec.packed else kmers)(self.unitigs.select("left_end", "right_end", "sequence"), k, ("left_end", "right_end")).drop("pos")
        touched = changed.unionByName(changed.select(codec.reverse(c).alias("kmer"))).distinct() if self.canonical else changed
        opened = listed.join(touched, "kmer", "left_semi").select("left_end", "right_end").distinct()
        again = listed.join(opened, ["left_end", "right_end"], "left_semi").select("kmer")
        if self.canonical:
            again = again.unionByName(again.select(codec.reverse(c).alias("kmer")))
        plain = again.unionByName(fresh).distinct().join(made.degrees.where("left_degree <= 1 and right_degree <= 1").select("kmer"), "kmer", "left_semi")
        kept = self.unitigs.join(opened, ["left_end", "right_end"], "left_anti").select(*self.unitigs.columns)
        made.unitigs = stored(kept.unionByName(made._classified(made._unitigs(plain))), "unitigs")
        return made

    def _key(self, df: DataFrame, column: str = "kmer") -> Column:
        c = F.col(column)
        return self.codec.key(c) if dict(df.dtypes)[column] == "string" else c

    @property
    def nodes(self) -> DataFrame:
        return self.packed_nodes.select(self.codec.text(F.col("kmer")).alias("kmer"), "count")

    # --- chains

    def _blocks(self, plain: DataFrame) -> DataFrame:
        """(head, tail, n, least of both strands, low of its own, sequence) of chains within blocks; links between blocks are left open."""
        codec, c = self.codec, F.col("kmer")
        if not codec.packed:
            return plain.select(c.alias("head"), c.alias("tail"), F.lit(1).cast("long").alias("n"), F.least(c, codec.reverse(c)).alias("least"), c.alias("low"), c.alias("sequence"))
        m = min(MINIMIZER, self.k)
        places = F.sequence(F.lit(0), F.lit(2 * (self.k - m)), F.lit(2))
        grams = F.transform(places, lambda i: F.xxhash64(F.call_function("shiftright", c, i).bitwiseAND(F.lit((1 << 2 * m) - 1))))
        ship_package(plain)
        dealt = plain.withColumn("__m", F.array_min(grams)).repartition("__m").sortWithinPartitions("__m").select("kmer")
        return dealt.mapInArrow(chain_batches(self.k), "head long, tail long, n long, least long, low long, sequence string")

    def _unitigs(self, plain: DataFrame) -> DataFrame:
        """(circular, least, low, sequence) of maximal chains."""
        codec, relay = self.codec, Relay("jump")
        part = stored(self._blocks(plain), "blocks")
        heads = part.select(F.col("head").alias("next"), codec.prefix(F.col("head")).alias("__o"))
        link = part.select(F.col("head").alias("up"), F.col("n").alias("far"), codec.suffix(F.col("tail")).alias("__o")).join(heads, "__o").select(F.col("next").alias("head"), "up", "far")
        # up: the part 2**round parts before, null past the first; root: that or the first part; step: k-mers between
        state = part.select("head", "least").join(link, "head", "left")
        state = state.select("head", F.coalesce("up", "head").alias("root"), "up", F.coalesce("far", F.lit(0)).cast("long").alias("step"), F.col("head").alias("low"))
        state, link = relay.put(state), stored(link, "links")
        before = -1
        while True:
            n_open = state.where("up is not null").count()
            if n_open == 0 or (n_open == before and self._all_circular(state)):
                break
            before = n_open
            far = state.select(F.col("head").alias("up"), F.col("root").alias("__r"), F.col("up").alias("__u"), F.col("step").alias("__s"), F.col("low").alias("__l"))
            state = relay.put(
                state.join(far, "up", "left").select(
                    "head", F.coalesce("__r", "root").alias("root"), F.col("__u").alias("up"), (F.col("step") + F.coalesce("__s", F.lit(0))).alias("step"), F.least("low", F.coalesce("__l", F.col("up"), F.col("low"))).alias("low")
                )
            )
        lines = state.where("up is null").select("head", "root", "step", F.lit(False).alias("circular"))
        placed = lines.unionByName(self._cycles(state.where("up is not null"), link)) if n_open else lines
        rows = placed.join(part, "head").select("root", "circular", "least", "low", F.struct("step", "sequence").alias("x"))
        rows = rows.groupBy("root", "circular").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.min("least").alias("least"), F.min("low").alias("low"))
        rest = F.transform(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), lambda x: F.substr(x["sequence"], F.lit(self.k)))
        return rows.select("circular", "least", "low", F.concat(F.col("xs")[0]["sequence"], F.concat_ws("", rest)).alias("sequence"))

    @staticmethod
    def _all_circular(state: DataFrame) -> bool:
        """Whether every open part has seen its whole cycle: its least is that of the part before."""
        rest = state.where("up is not null")
        up = rest.select(F.col("head").alias("up"), F.col("low").alias("__l"))
        return rest.join(up, "up").where("low <> __l").limit(1).count() == 0

    @staticmethod
    def _cycles(rest: DataFrame, link: DataFrame) -> DataFrame:
        """Cycles, opened at the part of their least head: the step of each part is its distance from there."""
        relay = Relay("open-cycles")
        rest = stored(rest.select("head", F.col("low").alias("root")), "cycles")
        kept = link.join(rest, "head").where("head <> root").select("head", "up", "far")
        state = relay.put(rest.join(kept, "head", "left").select("head", "root", "up", F.coalesce("far", F.lit(0)).cast("long").alias("step")))
        while state.where("up is not null").limit(1).count():
            far = state.select(F.col("head").alias("up"), F.col("up").alias("__u"), F.col("step").alias("__s"))
            state = relay.put(state.join(far, "up", "left").select("head", "root", F.col("__u").alias("up"), (F.col("step") + F.coalesce("__s", F.lit(0))).alias("step")))
        return state.select("head", "root", "step", F.lit(True).alias("circular"))

    def _opened(self, sequence: Column, low: Column) -> Column:
        """A cycle's sequence from its least k-mer ``low`` on, once round and k-1 further."""
        k = self.k
        n = F.length(sequence) - k + 1
        at = F.instr(sequence, self.codec.text(low))
        ring = F.substr(sequence, F.lit(1), n)
        turned = F.concat(F.substr(ring, at, n), F.substr(ring, F.lit(1), at - 1))
        return F.substr(F.repeat(turned, F.ceil((n + k - 1) / n).cast("int")), F.lit(1), n + k - 1)

    def _classified(self, chains: DataFrame) -> DataFrame:
        codec, k = self.codec, self.k
        rows = chains.withColumn("sequence", F.when(F.col("circular"), self._opened(F.col("sequence"), F.col("low"))).otherwise(F.col("sequence")))
        if self.canonical:
            flipped = F.reverse(F.translate("sequence", SYMBOLS, SYMBOLS[::-1]))
            lines = rows.where(~F.col("circular") & (F.col("sequence") <= flipped))
            rings = rows.where("circular").groupBy("least").agg(F.min_by(F.struct(*[c for c in rows.columns]), "sequence").alias("x")).select("x.*")
            rows = lines.unionByName(rings)
        end = lambda e: F.substr("sequence", F.lit(1), F.lit(k)) if e == "left" else F.substr(F.col("sequence"), F.length("sequence") - k + 1)
        rows = stored(rows.select("sequence", "circular", end("left").alias("left_end"), end("right").alias("right_end")), "chains")
        d = self._decisions.select("kmer")
        # an end has one neighbour at most, so one decision node at most is beside it
        left = d.select(codec.suffix(F.col("kmer")).alias("__lo"), F.col("kmer").alias("__l")).join(self._ends(rows, "left"), "__lo")
        right = d.select(codec.prefix(F.col("kmer")).alias("__ro"), F.col("kmer").alias("__r")).join(self._ends(rows, "right"), "__ro")
        rows = rows.join(left.select("left_end", self._name(F.col("__l")).alias("left_dnode")), "left_end", "left")
        rows = rows.join(right.select("right_end", self._name(F.col("__r")).alias("right_dnode")), "right_end", "left")
        meta = (
            F.when(F.length("sequence") == k, "TRIVIAL")
            .when(F.col("circular"), "CIRCULAR")
            .when(F.col("left_dnode").isNull() & F.col("right_dnode").isNull(), "ISLAND")
            .when(F.col("left_dnode") == F.col("right_dnode"), "LOOP")
            .when(F.col("left_dnode").isNull() | F.col("right_dnode").isNull(), "TIP")
            .otherwise("FULL")
        )
        return rows.select(
            F.xxhash64("left_end", "right_end").alias("node_id"), "sequence", F.length("sequence").alias("length"), "left_end", "right_end", meta.alias("meta"), "left_dnode", "right_dnode", "circular"
        )

    def _ends(self, rows: DataFrame, side: str) -> DataFrame:
        c = f"{side}_end"
        key = self.codec.key(F.col(c))
        lines = rows.where(~F.col("circular"))
        return lines.select(c, (self.codec.prefix(key) if side == "left" else self.codec.suffix(key)).alias("__lo" if side == "left" else "__ro"))

    def _name(self, kmer: Column) -> Column:
        """The text under which a decision node is listed."""
        return self.codec.text(F.least(kmer, self.codec.reverse(kmer)) if self.canonical else kmer)

    # --- reports

    def metrics(self) -> DataFrame:
        """(meta, n) of unitigs, and of decision nodes."""
        return self.unitigs.groupBy("meta").agg(F.count("*").alias("n")).unionByName(self.dnodes.select(F.lit("DECISION").alias("meta")).groupBy("meta").agg(F.count("*").alias("n")))

    def report(self) -> DataFrame:
        """One row: the number of unitigs of each kind, of decision nodes, unitig ends and distinct k-mers."""
        kinds = ("FULL", "TIP", "ISLAND", "TRIVIAL", "CIRCULAR", "LOOP")
        own = self.unitigs.agg(
            *[F.count_if(F.col("meta") == m).alias(f"n_{m.lower()}") for m in kinds], F.count("*").alias("n_unodes"), F.coalesce(F.sum(F.when(F.col("left_end") == F.col("right_end"), 1).otherwise(2)), F.lit(0)).cast("long").alias("n_ends")
        )
        return own.crossJoin(self.dnodes.agg(F.count("*").alias("n_dnodes"))).crossJoin(self._listed().agg(F.count("*").alias("n_unique_kmers")))

    def _listed(self) -> DataFrame:
        """Nodes, of both strands once."""
        return self.packed_nodes.where(F.col("kmer") <= self.codec.reverse(F.col("kmer"))) if self.canonical else self.packed_nodes

    def length_histogram(self, bins: Sequence[int]) -> DataFrame:
        """(bin, n_kmers): unitig k-mers per half-open bin [b, next); the last is open."""
        bin_ = F.lit(None).cast("int")
        for b in bins:
            bin_ = F.when(F.col("length") >= b, F.lit(b)).otherwise(bin_)
        return self.unitigs.select(bin_.alias("bin"), (F.col("length") - self.k + 1).cast("long").alias("n")).groupBy("bin").agg(F.sum("n").alias("n_kmers"))

    def _every(self) -> DataFrame:
        """(node, enters, leaves, circular): first and last k-mers of every node on every strand."""
        codec = self.codec
        u = self.unitigs.select(F.concat(F.lit("u:"), "left_end").alias("node"), codec.key(F.col("left_end")).alias("a"), codec.key(F.col("right_end")).alias("b"), "circular")
        d = self.dnodes.select(F.concat(F.lit("d:"), "kmer").alias("node"), codec.key(F.col("kmer")).alias("a"), codec.key(F.col("kmer")).alias("b"), F.lit(False).alias("circular"))
        every = u.unionByName(d)
        if self.canonical:
            every = every.unionByName(every.select("node", codec.reverse(F.col("b")).alias("a"), codec.reverse(F.col("a")).alias("b"), "circular"))
        return every

    def links(self) -> DataFrame:
        """(source, sink) between unitigs (``u:left_end``) and decision nodes (``d:kmer``): one leaves with what the other enters with.

        Of a graph of both strands, a link is listed once in each direction in which it can be read.
        """
        codec, every = self.codec, self._every().where(~F.col("circular"))
        out = every.select(F.col("node").alias("source"), codec.suffix(F.col("b")).alias("o"))
        into = every.select(F.col("node").alias("sink"), codec.prefix(F.col("a")).alias("o"))
        return out.join(into, "o").select("source", "sink").distinct()

    def components(self) -> DataFrame:
        """(node, component) over unitigs and decision nodes; a component's id is its least node."""
        every = self.unitigs.select(F.concat(F.lit("u:"), "left_end").alias("node")).unionByName(self.dnodes.select(F.concat(F.lit("d:"), "kmer").alias("node")))
        return connected_components(every, self.links().select(F.col("source").alias("a"), F.col("sink").alias("b")))

    def component_stats(self) -> DataFrame:
        """(n_components, max, min) of component sizes in nodes."""
        sizes = self.components().groupBy("component").agg(F.count("*").alias("n"))
        return sizes.agg(F.count("*").alias("n_components"), F.max("n").alias("max"), F.min("n").alias("min"))

    def kmers(self) -> DataFrame:
        """(kmer, node, pos) of the packed k-mers of unitigs and decision nodes, as listed."""
        k, codec = self.k, self.codec
        rows = (packed_kmers if codec.packed else kmers)(self.unitigs.select("left_end", "sequence"), k, ("left_end",))
        rows = rows.select("kmer", F.concat(F.lit("u:"), "left_end").alias("node"), F.col("pos").cast("long").alias("pos"))
        return rows.unionByName(self.dnodes.select(codec.key(F.col("kmer")).alias("kmer"), F.concat(F.lit("d:"), "kmer").alias("node"), F.lit(0).cast("long").alias("pos")))

    def validate(self) -> DataFrame:
        """(n_nodes, n_in_graph, n_missing, n_foreign, n_repeated): k-mers of the store and of the graph, and where they differ."""
        codec, c = self.codec, F.col("kmer")
        own = self.kmers().select(F.least(c, codec.reverse(c)).alias("kmer") if self.canonical else c).groupBy("kmer").agg(F.count("*").alias("n"))
        both = own.join(self._listed().select("kmer", F.lit(True).alias("known")), "kmer", "full")
        return both.agg(
            F.count("known").alias("n_nodes"), F.count("n").alias("n_in_graph"), F.count_if(F.col("n").isNull()).alias("n_missing"),
            F.count_if(F.col("known").isNull()).alias("n_foreign"), F.count_if(F.col("n") > 1).alias("n_repeated"),
        )

    # --- lookups

    def find(self, texts: DataFrame) -> DataFrame:
        """(kmer, node, pos, strand) of text k-mers that the graph holds: their node, their place in it, ``+`` or ``-``."""
        codec, c = self.codec, F.col("kmer")
        asked = texts.select("kmer", codec.key(c).alias("__q")).distinct()
        if self.canonical:
            both = F.array(F.struct(F.col("__q").alias("key"), F.lit("+").alias("strand")), F.struct(codec.reverse(F.col("__q")).alias("key"), F.lit("-").alias("strand")))
            asked = asked.select("kmer", F.explode(both).alias("x")).select("kmer", "x.key", "x.strand")
        else:
            asked = asked.select("kmer", F.col("__q").alias("key"), F.lit("+").alias("strand"))
        own = self.kmers().withColumnRenamed("kmer", "key")
        return own.join(asked, "key").select("kmer", "node", "pos", "strand").dropDuplicates(["kmer"])

    def twins(self) -> DataFrame:
        """(node, twin): the node that begins with the reverse complement of a node's first k symbols (one-strand graphs)."""
        codec = self.codec
        every = self._every()
        first = every.select("node", codec.reverse(F.col("a")).alias("a"))
        return first.join(every.select(F.col("node").alias("twin"), "a"), "a").select("node", "twin")

    def reach(self, roots: DataFrame) -> DataFrame:
        """(root, node): all nodes that links lead to from each root, in either direction; the root itself too.

        What a root reaches is its component, so the work does not grow with the number of steps.
        """
        c = stored(self.components(), "reach")
        own = roots.select(F.col("node").alias("root")).distinct().join(c.withColumnRenamed("node", "root"), "root")
        return own.join(c, "component").select("root", "node")

    # --- walks

    def walks(self, seeds: DataFrame, side: str = "right", stop: DataFrame | None = None) -> DataFrame:
        """(seed, sequence, end_state) of the walk from every seed (text k-mers) to one side.

        A walk inside a unitig is the rest of it, so none takes steps of its own.
        STOP_FWD: no neighbour; DECISION_FWD: more than one (the walk ends with the
        decision node); DECISION_BKW: the only neighbour branches backwards (it is
        left out); STOP_SEEN: the neighbour is on the walk; STOP_MASKED: ``stop``
        holds the neighbour (it ends steps and is no mask: masks are the graph's);
        BAD_SEED: the seed is not in the graph.  Walks go along the strand of their seed.
        """
        codec, k = self.codec, self.k
        right = side == "right"
        ahead, back = ("right_degree", "left_degree") if right else ("left_degree", "right_degree")
        asked = seeds.select(F.col("kmer").alias("seed")).distinct().withColumn("key", codec.key(F.col("seed")))
        # rows of every strand: the sequence as read there, its ends
        u = self.unitigs.select("sequence", "circular")
        if self.canonical:
            flipped = F.reverse(F.translate("sequence", SYMBOLS, SYMBOLS[::-1]))
            u = u.unionByName(u.where(F.col("sequence") != flipped).select(flipped.alias("sequence"), "circular"))
        u = u.withColumn("id", F.xxhash64("sequence"))
        places = (packed_kmers if codec.packed else kmers)(u.select("id", "sequence"), k, ("id",))
        places = places.select("id", F.col("pos").cast("int").alias("pos"), F.col("kmer").alias("key"))
        whole = F.length("sequence")
        ring = F.substr("sequence", F.lit(1), whole - k + 1)

        def rest(pos: Column) -> Column:
            """The walk through a unitig from the k-mer at ``pos`` on."""
            if right:
                line = F.substr("sequence", pos + 1, whole)
                round_ = F.concat(F.substr(ring, pos + 1, whole), F.substr(ring, F.lit(1), pos))
                return F.when(F.col("circular"), F.substr(F.repeat(round_, F.ceil(whole / F.length(ring)).cast("int")), F.lit(1), whole)).otherwise(line)
            line = F.substr("sequence", F.lit(1), pos + k)
            end = pos + k - F.floor((pos + k) / F.length(ring)) * F.length(ring)
            turned = F.concat(F.substr(ring, end.cast("int") + 1, whole), F.substr(ring, F.lit(1), end.cast("int")))
            around = F.repeat(turned, F.ceil(whole / F.length(ring)).cast("int"))
            return F.when(F.col("circular"), F.substr(around, F.length(around) - whole + 1, whole)).otherwise(line)

        known = self.degrees.select(F.col("kmer").alias("key"), F.col(ahead).alias("out"), F.col(back).alias("back"))
        start = asked.join(known, "key", "left")
        bad = start.where("out is null").select("seed", F.col("seed").alias("sequence"), F.lit("BAD_SEED").alias("end_state"))
        start = start.where("out is not null")
        inside = start.where("out <= 1 and back <= 1").join(places, "key").join(u, "id").select("seed", rest(F.col("pos")).alias("walked"), "circular", F.lit(False).alias("done"))
        branching = start.where("out > 1").select("seed", F.col("seed").alias("walked"), F.lit(False).alias("circular"), F.lit(True).alias("done"))
        # a seed that several join, with one neighbour at most: one step, then as from there
        single = start.where("out <= 1 and back > 1").select("seed", F.col("seed").alias("walked"), F.lit(False).alias("circular"), F.lit(False).alias("done"))
        tip = F.col("walked")
        tip = codec.key(F.substr(tip, F.length(tip) - k + 1)) if right else codec.key(F.substr(tip, F.lit(1), F.lit(k)))
        overlap = codec.suffix(tip) if right else codec.prefix(tip)
        near = self.degrees.select(
            F.col("kmer").alias("next"), (codec.prefix(F.col("kmer")) if right else codec.suffix(F.col("kmer"))).alias("o"), F.col(ahead).alias("next_out"), F.col(back).alias("next_back")
        )

        def step(rows: DataFrame) -> DataFrame:
            """rows with what stands ahead of their tips."""
            return rows.withColumn("o", F.when(~F.col("circular") & ~F.col("done"), overlap)).join(near, "o", "left")

        one = step(single)
        into = one.drop("circular").where("next_back = 1 and next_out <= 1").join(places.withColumnRenamed("key", "next"), "next").join(u, "id")
        glue = F.concat("walked", F.substr(rest(F.col("pos")), F.lit(k))) if right else F.concat(F.substr(rest(F.col("pos")), F.lit(1), F.length(rest(F.col("pos"))) - k + 1), F.col("walked"))
        through = into.select("seed", glue.alias("walked"), "circular", F.lit(False).alias("done"))
        stay = one.where("not (next_back = 1 and next_out <= 1) or next is null").select("seed", "walked", "circular", "done")
        rows = step(inside.unionByName(through).unionByName(stay).unionByName(branching))
        state = (
            F.when(F.col("done"), "DECISION_FWD").when(F.col("circular"), "STOP_SEEN").when(F.col("next").isNull(), "STOP_FWD")
            .when(F.col("next") == tip, "STOP_SEEN").when(F.col("next_back") > 1, "DECISION_BKW").otherwise("DECISION_FWD")
        )
        symbol = F.substr(F.lit(SYMBOLS), codec.last(F.col("next")) + 1, F.lit(1)) if right else F.substr(F.lit(SYMBOLS), codec.first(F.col("next")) + 1, F.lit(1))
        taken = F.when((state == "DECISION_FWD") & ~F.col("done"), F.concat("walked", symbol) if right else F.concat(symbol, F.col("walked"))).otherwise(F.col("walked"))
        # a walk may come back to its own seed, a node that several join
        back_home = ~F.col("done") & (F.col("next") == codec.key(F.col("seed")))
        rows = rows.select("seed", taken.alias("sequence"), F.when(back_home, "STOP_SEEN").otherwise(state).alias("end_state"), codec.text(F.col("next")).alias("next"))
        if stop is None:
            return rows.drop("next").unionByName(bad)
        return self._stopped(rows, stop, right).unionByName(bad)

    def _stopped(self, rows: DataFrame, stop: DataFrame, right: bool) -> DataFrame:
        """Walks cut before the first k-mer after the seed that ``stop`` holds."""
        k, codec = self.k, self.codec
        held = stop.select(codec.key(F.col("kmer")).alias("kmer")).distinct()
        read = F.col("sequence") if right else F.reverse("sequence")
        # the node left out of a walk may be a stopper too
        ahead = F.when(F.col("end_state") == "DECISION_BKW", F.substr("next", F.lit(k)) if right else F.substr("next", F.lit(1), F.lit(1))).otherwise("")
        long = rows.select("seed", F.concat("sequence", ahead).alias("sequence") if right else F.concat(ahead, F.col("sequence")).alias("sequence"))
        on = (packed_kmers if codec.packed else kmers)(long, k, ("seed",))
        n = long.select("seed", (F.length("sequence") - k).alias("last"))
        on = on.join(held, "kmer", "left_semi").join(n, "seed").select("seed", (F.col("pos") if right else F.col("last") - F.col("pos")).cast("int").alias("at")).where("at > 0")
        first = on.groupBy("seed").agg(F.min("at").alias("at"))
        rows = rows.join(first, "seed", "left")
        size = F.col("at") + k - 1
        cut = F.substr(read, F.lit(1), size)
        return rows.select("seed", F.when(F.col("at").isNull(), F.col("sequence")).otherwise(cut if right else F.reverse(cut)).alias("sequence"), F.when(F.col("at").isNull(), F.col("end_state")).otherwise("STOP_MASKED").alias("end_state"))


def connected_components(node: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) by hooking to the least neighbour's component and shortcutting, until nothing changes."""
    both = stored(links.where("a <> b").select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    relay = Relay("components")
    state = relay.put(node.select("node", F.col("node").alias("component")).distinct())
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        hooked = state.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("m", "component")).alias("new"))
        jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("root"))
        after = hooked.join(jump, "new", "left").select("node", "component", F.least("new", F.coalesce("root", "new")).alias("new"))
        after = relay.put(after)
        if after.where("component <> new").limit(1).count() == 0:
            return after.select("node", "component")
        state = after.select("node", F.col("new").alias("component"))


# --- edits of single nodes: rows in, rows out


def clipped(unitigs: DataFrame, k: int, side: str = "left") -> DataFrame:
    """(node_id, sequence) one k-mer shorter at an end; a unitig of one k-mer is gone."""
    rest = F.substr("sequence", F.lit(2)) if side == "left" else F.substr("sequence", F.lit(1), F.length("sequence") - 1)
    return unitigs.where(F.length("sequence") > k).select("node_id", rest.alias("sequence"))


def extended(unitigs: DataFrame, k: int, side: str = "right", more: str = "more") -> DataFrame:
    """(node_id, sequence) with the text of column ``more``, which overlaps the end by k-1, added; one that does not overlap is an error."""
    s, m = F.col("sequence"), F.col(more)
    if side == "right":
        fits, whole = F.substr(s, F.length(s) - k + 2) == F.substr(m, F.lit(1), F.lit(k - 1)), F.concat(s, F.substr(m, F.lit(k)))
    else:
        fits, whole = F.substr(s, F.lit(1), F.lit(k - 1)) == F.substr(m, F.length(m) - k + 2), F.concat(F.substr(m, F.lit(1), F.length(m) - k + 1), s)
    return unitigs.select("node_id", F.when(fits, whole).otherwise(F.raise_error(F.lit("no overlap")).cast("string")).alias("sequence"))


def split(unitigs: DataFrame, k: int, at: str = "at", circular: str = "circular") -> DataFrame:
    """(node_id, part, sequence) of unitigs without the k-mer at place ``at``: what is left of it and right of it; a circular one is opened there into one."""
    s, p, n = F.col("sequence"), F.col(at).cast("int"), F.length("sequence") - k + 1
    ring = F.substr(s, F.lit(1), n)
    open_ = F.concat(F.substr(ring, p + 2, n), F.substr(ring, F.lit(1), p + 1))
    around = F.substr(F.repeat(open_, F.ceil((n + k - 1) / n).cast("int")), F.lit(1), n - 1 + k - 1)
    parts = F.when(F.col(circular), F.array(F.struct(F.lit(0).alias("part"), F.when(n > 1, around).alias("sequence")))).otherwise(
        F.array(
            F.struct(F.lit(0).alias("part"), F.when(p > 0, F.substr(s, F.lit(1), p + k - 1)).alias("sequence")),
            F.struct(F.lit(1).alias("part"), F.when(p < n - 1, F.substr(s, p + 2, n + k)).alias("sequence")),
        )
    )
    return unitigs.select("node_id", F.explode(parts).alias("x")).select("node_id", "x.part", "x.sequence").where("sequence is not null")


def merged(pairs: DataFrame, k: int, left: str = "left", span: str = "span", right: str = "right") -> DataFrame:
    """(sequence, circular) of two unitigs joined by the text between them, which overlaps both by k-1; one joined to itself becomes a cycle."""
    a, m, b = F.col(left), F.col(span), F.col(right)
    line = F.concat(a, F.substr(m, F.lit(k)), F.substr(b, F.lit(k)))
    ring = F.concat(a, F.substr(m, F.lit(k)))
    return pairs.select(F.when(a == b, ring).otherwise(line).alias("sequence"), (a == b).alias("circular"))


def flipped(unitigs: DataFrame) -> DataFrame:
    """(node_id, sequence) read on the other strand: left and right ends change places."""
    return unitigs.select("node_id", F.reverse(F.translate("sequence", SYMBOLS, SYMBOLS[::-1])).alias("sequence"))
