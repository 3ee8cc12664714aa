"""Operator 10: near-duplicate documents by MinHash with tensored banding.

Table keys are formed by combining one half from each of two small collections
of half keys: ``m + m`` halves of ``r`` minhashes give ``m * m`` tables, so a
document computes ``2 * m * r`` minhashes where plain banding needs
``2 * m * m * r``.

1. Every document is hashed once; equal shingle sets form a class, and only its
   representative goes on.
2. Each table's bucket proposes a star: its least member against every other.
   Stars are verified on full shingle sets; no pairs within a bucket are listed.
3. Buckets of three or more members whose star was not wholly confirmed may hide
   links between two non-centres.  Their members are joined on prefixes of their
   sets (rarest first, with the positional bound), which loses no pair, and what
   that proposes is verified too.
4. Verified links are contracted to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm import text_kernels as tk
from strandlake.llm.components import connected_components
from strandlake.llm.scratch import fresh_name, ship_package, stored, with_group

SHINGLE_WORDS = 5
#: Slots of the frequency table that orders a prefix; any order gives the same links.
ORDER_SLOTS = 1 << 18


def halves_for(similarity: float, hashes_per_half: int, miss: float) -> int:
    """Least m for which a pair at the threshold misses all m*m tables with probability below ``miss``."""
    p = similarity**hashes_per_half
    return max(1, math.ceil(math.log(miss / 2) / math.log(1 - p)))


def _signatures(width: int, m: int, r: int):
    mult = tk.hash_weights(2 * m * r, 0xA11CE)
    add = tk.hash_weights(2 * m * r, 0xB0B)
    join = tk.hash_weights(r, 0x7AB1E)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                h, at = tk.shingle_sets(part.column("text"), width)
                n = np.diff(at)
                full = np.flatnonzero(n)
                sums = np.zeros((2, len(n)), np.uint64)
                halves = np.zeros((2 * m, len(n)), np.uint64)
                if len(full):
                    first = at[:-1][full]
                    sums[0, full] = np.add.reduceat(h, first)
                    sums[1, full] = np.add.reduceat(tk.mix64(h ^ np.uint64(0xD1F)), first)
                    for k in range(2 * m * r):
                        low = np.minimum.reduceat(h * mult[k] + add[k], first)
                        halves[k // r, full] += low * join[k % r]
                    halves = tk.mix64(halves)
                flat = pa.array(np.ascontiguousarray(halves.T).reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, 2 * m, dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "halves"],
                )

    return run


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text_b", tk.SLICE_BYTES // 2):
                b, b_at = tk.shingle_sets(part.column("text_b"), width)
                left, a_index = _distinct_texts(part.column("text_a"), part.column("a"))
                a, a_at = tk.shingle_sets(left, width)
                n_a, n_b = np.diff(a_at)[a_index], np.diff(b_at)
                # one lookup table for the slice: hash and left row, searched by right rows
                both = np.zeros(len(n_b), np.int64)
                for i in range(len(n_b)):
                    x = a[a_at[a_index[i]] : a_at[a_index[i] + 1]]
                    y = b[b_at[i] : b_at[i + 1]]
                    if len(x) and len(y):
                        place = np.searchsorted(x, y)
                        place[place == len(x)] = 0
                        both[i] = np.count_nonzero(x[place] == y)
                linked = 100 * both >= percent * (n_a + n_b - both)
                keep = pa.array(linked & (n_b > 0))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    return run


def _distinct_texts(texts: pa.Array, ids: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts of distinct ids (rows come sorted by id), and each row's place among them."""
    ids = np.asarray(ids)
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    return tk.text_column(texts).take(pa.array(np.flatnonzero(new))), np.cumsum(new) - 1


def _order_counts(width: int):
    """Per task, counts of shingles by slot: a table of fixed size, summed over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_SLOTS, np.int64)
        for batch in batches:
            for part in tk.slices(batch):
                h, _ = tk.shingle_sets(part.column("text"), width)
                total += np.bincount((h >> np.uint64(32)).astype(np.int64) % ORDER_SLOTS, minlength=ORDER_SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    return run


def _prefixes(width: int, percent: int, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                h, at = tk.shingle_sets(part.column("text"), width)
                rarity = counts[(h >> np.uint64(32)).astype(np.int64) % ORDER_SLOTS]
                n = np.diff(at)
                doc = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, rarity, doc))
                take = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                rows = order[tk.ranges(at[:-1], take)]
                place = tk.ranges(np.zeros(len(n), np.int64), take)
                own = pa.array(np.repeat(np.arange(len(n)), take))
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep").take(own), part.column("component").take(own), pa.array(n[doc[rows]]), pa.array(h[rows].view(np.int64)), pa.array(place)],
                    names=["rep", "component", "n", "shingle", "place"],
                )

    return run


def _tensor(m: int) -> Column:
    """All m*m table keys of an array of 2*m halves."""
    a, b = F.slice("halves", 1, m), F.slice("halves", m + 1, m)
    return F.flatten(F.transform(a, lambda x, i: F.transform(b, lambda y, j: F.xxhash64(x, y, i * m + j))))


class NearDuplicates:
    """Similarity classes of documents: Jaccard of word shingles at least ``percent``/100.

    Nulls and empty texts have an empty set: no links, and they are their own
    component.  A null doc_id takes part in links of others' classes no more
    than its text does: it gets the component of its text, its least non-null
    member.  Repeated rows each get a row.  An empty table gives no rows.
    Columns besides doc_id and text are ignored.
    """

    def __init__(self, percent: int = 85, width: int = SHINGLE_WORDS, hashes_per_half: int = 2, miss: float = 1e-4):
        self.percent, self.width, self.r = percent, width, hashes_per_half
        self.m = halves_for(percent / 100, hashes_per_half, miss)

    def signatures(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, set_a, set_b, halves): one pass over all texts."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return rows.mapInArrow(_signatures(self.width, self.m, self.r), "doc_id long, n_shingles long, set_a long, set_b long, halves array<long>")

    def components(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept) per row of ``docs``."""
        ship_package(docs.sparkSession)
        every = stored(self.signatures(docs), "signatures")
        reps = stored(
            every.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves")),
            "classes",
        )
        texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
        links = self.links(reps, texts)
        node = connected_components(links, "a", "b").withColumnRenamed("node", "rep")
        classes = reps.drop("halves").join(node, "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("class_id"))
        out = every.drop("halves").join(classes, ["set_a", "set_b", "n_shingles"], "left")
        component = F.coalesce("class_id", "doc_id")
        return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))

    def links(self, reps: DataFrame, texts: DataFrame) -> DataFrame:
        """Verified links (a, b) that connect the classes; a < b."""
        sizes = reps.select("rep", "n_shingles")
        keys = reps.select("rep", F.explode(_tensor(self.m)).alias("key"))
        buckets = stored(keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("members")).where("members > 1"), "buckets")
        stars = stored(with_group(keys, buckets, "key", "members", "rep").where("rep <> hub").select("key", "members", "hub", "rep"), "stars")
        # texts move once: later steps only look at documents that share a bucket
        sharing = stars.select("rep").unionByName(stars.select(F.col("hub").alias("rep"))).distinct()
        texts = stored(texts.join(sharing, "rep", "left_semi").dropDuplicates(["rep"]), "texts")
        pairs = stars.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
        confirmed = stored(self.verify(pairs, sizes, texts), "confirmed")
        node = stored(connected_components(confirmed, "a", "b"), "nodes")
        open_stars = stars.where("members > 2")
        hub = node.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
        own = node.select(F.col("node").alias("rep"), "component")
        # one row a bucket: whether all its members are in the hub's component
        component = F.coalesce("component", "rep")
        split = open_stars.join(own, "rep", "left").groupBy("key").agg(F.min(component).alias("lo"), F.max(component).alias("hi"), F.min("hub").alias("hub"), F.count("*").alias("n"))
        split = split.join(hub, "hub", "left").where("lo <> hi or lo <> coalesce(hub_component, hub)").select("key", "n")
        mixed = with_group(open_stars, stored(split, "split"), "key", "n", "rep").where("n is not null")
        active = mixed.select("rep").unionByName(mixed.select(F.col("hub").alias("rep"))).distinct()
        active = active.join(own, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))
        more = self.verify(self.prefix_pairs(active, texts), sizes, texts)
        return confirmed.unionByName(more)

    def prefix_pairs(self, active: DataFrame, texts: DataFrame) -> DataFrame:
        """Pairs of different components that may reach the threshold; complete by the prefix bound."""
        rows = stored(active.join(texts, "rep"), "active")
        counts = np.zeros(ORDER_SLOTS, np.int64)
        slots = rows.mapInArrow(_order_counts(self.width), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        for slot, n in slots.collect():  # at most ORDER_SLOTS rows
            counts[slot] = n
        prefix = rows.mapInArrow(_prefixes(self.width, self.percent, counts), "rep long, component long, n long, shingle long, place long")
        prefix = stored(prefix, "prefixes")
        shared = prefix.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle")
        prefix = prefix.join(shared, "shingle", "left_semi")
        x = prefix.select("shingle", *[F.col(c).alias("x_" + c) for c in ("rep", "component", "n", "place")])
        y = prefix.select("shingle", *[F.col(c).alias("y_" + c) for c in ("rep", "component", "n", "place")])
        need = F.expr(f"{100 + self.percent} * least(x_n - x_place, y_n - y_place) >= {self.percent} * (x_n + y_n)")
        close = F.expr(f"100 * least(x_n, y_n) >= {self.percent} * greatest(x_n, y_n)")
        on = (x.shingle == y.shingle) & (F.col("x_component") != F.col("y_component")) & (F.col("x_rep") < F.col("y_rep")) & close & need
        return x.join(y, on).select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b")).distinct()

    def verify(self, pairs: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
        """Pairs (a, b) whose full shingle sets reach the threshold."""
        n_a = sizes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"))
        n_b = sizes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"))
        near = pairs.join(n_a, "a").join(n_b, "b").where(f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)").select("a", "b")
        near = stored(near, "pairs")
        rows = near.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
        rows = rows.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").select("a", "text_a", "b", "text_b")
        return rows.mapInArrow(_verify(self.width, self.percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    return NearDuplicates(percent).components(docs)


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document stays: the least doc_id of each component.

    Rows of one id stay together; null and empty texts have no copies and stay;
    rows without a doc_id stay (they cannot be named as copies); an empty table
    gives no rows.  All columns are returned, whatever their names.
    """
    name = fresh_name(docs, "__kept")
    kept = near_duplicates(docs, percent).where("kept").select(F.col("doc_id").alias(name)).distinct()
    named = docs.join(kept, F.col("doc_id").cast("long") == F.col(name), "left_semi")
    return named.unionByName(docs.where("doc_id is null"))
