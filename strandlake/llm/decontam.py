"""Operator 7: benchmark decontamination by spaced seeds.

A document is contaminated by an item if some window of ``min(20, item length)``
aligned words agrees in at least 80 % of them, or in all of them if the item has
fewer than LEAST_WORDS words.  Fixed masks pick the positions
that a seed hashes; a substitution at an ignored position leaves the seed whole.
The masks are lossless: every way to place the allowed substitutions leaves one
of them whole (tests enumerate them).  Seeds of items and documents are joined
by hash, and the words around each hit are compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import text_kernels as tk
from strandlake.llm.scratch import fresh_name, ship_package

WINDOW = 20
PERCENT = 80
#: Kept positions of seeds, for items of at least LONG words and for shorter ones.
LONG = 14
MASKS = ((0, 2, 3, 4, 5), (0, 5, 6, 8, 9), (0, 1, 2, 5, 6))
SHORT_MASKS = ((0, 1, 2),)
#: Shorter items match where a document holds all their words in a row.
LEAST_WORDS = 8
#: Text bytes of the items that are broadcast at once; more items take more passes.
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 22
_CANDIDATES = 20_000

_WEIGHTS = tk.hash_weights(16, 0x5EED5)


def _seeds(h: np.ndarray, mask: tuple[int, ...], first: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(first), np.uint64)
    for k, o in enumerate(mask):
        acc += h[first + o] * _WEIGHTS[k]
    return tk.mix64(acc + np.uint64(len(mask)))


def _places(at: np.ndarray, span: int) -> np.ndarray:
    """Word places from which ``span`` words lie in one text."""
    room = np.maximum(np.diff(at) - span + 1, 0)
    return tk.ranges(at[:-1], room)


class Items:
    """Seed tables of a block of benchmark items."""

    def __init__(self, item_ids: list[int], texts: pa.Array):
        words = tk.Words(*tk.flat_bytes(texts))
        self.ids = np.array(item_ids, np.int64)
        self.hash, self.at = words.hash, words.at.astype(np.int64)
        size = np.diff(self.at)
        self.window = np.minimum(size, WINDOW)
        self.need = np.where(size < LEAST_WORDS, size, -(-PERCENT * self.window // 100))
        self.tables = []
        exact = [((tuple(range(n)),), size == n) for n in range(1, LEAST_WORDS)]
        for masks, chosen in ((MASKS, size >= LONG), (SHORT_MASKS, (size >= LEAST_WORDS) & (size < LONG)), *exact):
            for mask in masks if chosen.any() else ():
                first = _places(self.at, mask[-1] + 1)
                item = np.searchsorted(self.at, first, "right") - 1
                first, item = first[chosen[item]], item[chosen[item]]
                key = _seeds(self.hash, mask, first)
                order = np.argsort(key, kind="stable")
                maybe = np.zeros(1 << _FILTER_BITS, bool)
                maybe[key >> np.uint64(64 - _FILTER_BITS)] = True
                self.tables.append((mask, key[order], item[order], (first - self.at[item])[order], maybe))

    def hits(self, words: tk.Words) -> Iterator[tuple[np.ndarray, ...]]:
        """Distinct (document, item, shift), some _CANDIDATES a time: item word 0 stands at document word ``shift``."""
        at = words.at.astype(np.int64)
        found, held = [], 0

        def distinct() -> tuple[np.ndarray, ...]:
            first, item, place = (np.concatenate(x) for x in zip(*found, strict=True))
            doc = np.searchsorted(at, first, "right") - 1
            rows = np.unique(np.stack((doc, item, first - place - at[doc])), axis=1)
            return rows[0], rows[1], rows[2]

        for mask, keys, item, place, maybe in self.tables:
            first = _places(at, mask[-1] + 1)
            seed = _seeds(words.hash, mask, first)
            some = maybe[seed >> np.uint64(64 - _FILTER_BITS)]
            first, seed = first[some], seed[some]
            lo = np.searchsorted(keys, seed)
            n = np.searchsorted(keys, seed, "right") - lo
            first, lo, n = first[n > 0], lo[n > 0], n[n > 0]
            # a seed that many items share is expanded in steps
            sums, begin = np.cumsum(n), 0
            while begin < len(n):
                before = int(sums[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(sums, before + _CANDIDATES, "right")))
                rows = tk.ranges(lo[begin:end], n[begin:end])
                found.append((np.repeat(first[begin:end], n[begin:end]), item[rows], place[rows]))
                held, begin = held + len(rows), end
                if held >= _CANDIDATES:
                    yield distinct()
                    found, held = [], 0
        if held:
            yield distinct()

    def verified(self, words: tk.Words) -> tuple[np.ndarray, ...]:
        """(document, item, agreeing words, word of the document) of the best window of each pair that has one."""
        out = [self._verify(words, *hits) for hits in self.hits(words)]
        none = np.zeros(0, np.int64)
        doc, item, agree, word = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (none,) * 4
        order = np.lexsort((word, -agree, item, doc))
        doc, item, agree, word = doc[order], item[order], agree[order], word[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        return doc[new], item[new], agree[new], word[new]

    def _verify(self, words: tk.Words, doc: np.ndarray, item: np.ndarray, shift: np.ndarray):
        at = words.at.astype(np.int64)
        n_doc, n_item = np.diff(at)[doc], np.diff(self.at)[item]
        lo = np.maximum(0, -shift)  # item words from lo on stand in the document
        size = np.minimum(n_item, n_doc - shift) - lo
        fits = size >= self.window[item]
        doc, item, shift, lo, size = doc[fits], item[fits], shift[fits], lo[fits], size[fits]
        if len(doc) == 0:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        same = self.hash[tk.ranges(self.at[item] + lo, size)] == words.hash[tk.ranges(at[doc] + shift + lo, size)]
        sums = np.concatenate(([0], np.cumsum(same)))
        begin = np.cumsum(size) - size
        width = self.window[item]
        n = size - width + 1
        place = tk.ranges(begin, n)
        agree = sums[place + np.repeat(width, n)] - sums[place]
        own = np.cumsum(n) - n
        most = np.maximum.reduceat(agree, own)
        first = np.full(len(doc), np.iinfo(np.int64).max)
        best = agree == np.repeat(most, n)
        np.minimum.at(first, np.repeat(np.arange(len(doc)), n)[best], (place - np.repeat(begin, n))[best])
        ok = most >= self.need[item]
        return doc[ok], item[ok], most[ok], (shift + lo + first)[ok]


#: The last block's seed tables of this worker.
_tables: dict[int, Items] = {}


def items_of(shared) -> Items:
    """Seed tables of a broadcast block, built once a worker."""
    if shared.id not in _tables:
        _tables.clear()
        ids, texts = shared.value
        _tables[shared.id] = Items(ids, pa.array(texts, pa.large_string()))
    return _tables[shared.id]


class _Block:
    """A broadcast block of items and a number that tells it from others."""

    def __init__(self, spark, block: tuple[list[int], list[str]]):
        self.shared, self.id = spark.sparkContext.broadcast(block), uuid.uuid4().int

    @property
    def value(self):
        return self.shared.value


def _match(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = items_of(shared)
        for batch in batches:
            for part in tk.slices(batch):
                words = tk.Words(*tk.flat_bytes(part.column("text")))
                doc, item, agree, word = items.verified(words)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(items.ids[item]), pa.array(agree), pa.array(items.window[item]), pa.array(word)],
                    names=["doc_id", "item_id", "agreeing_words", "window_words", "first_word"],
                )

    return run


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """Items in blocks of bounded size, streamed to the driver."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.where("item_id is not null and text is not null").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text.encode("utf-8", "surrogatepass")) + 64
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each pair of a document and a benchmark item that it holds.

    doc_id, item_id, agreeing_words of the window_words of the best (then first)
    window, first_word where it starts in the document.  Items of fewer than
    LEAST_WORDS words match by all their words, in a row.  Null or empty texts and
    items without an id match nothing; a null doc_id is passed through; repeated
    rows repeat their matches; repeated items give one row for each id.  Either
    table may be empty: no rows.  Other columns are ignored.  Nothing is shuffled.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    schema = "doc_id long, item_id long, agreeing_words long, window_words long, first_word long"
    out = spark.createDataFrame([], schema)
    for n, block in enumerate(_blocks(benchmark)):
        found = rows.mapInArrow(_match(_Block(spark, block)), schema)
        out = found if n == 0 else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; of an id of which one row does, all rows go.

    Null and empty texts hold nothing and stay; rows without a doc_id stay; an
    empty table gives no rows, an empty benchmark all.  All columns are returned,
    whatever their names.
    """
    name = fresh_name(docs, "__bad")
    bad = contaminated(docs.where("doc_id is not null"), benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long") == F.col(name), "left_anti")
