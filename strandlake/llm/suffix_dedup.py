"""Operator 8: remove byte strings that occur more than once, by suffix arrays.

Every ``length``-byte string (window) is dealt to a shard by its anchor, the
least-hashing 32-byte gram inside it, so equal windows meet in one shard and
nothing else has to.  Consecutive windows with one anchor travel as a segment.

1. All texts: segments with their anchor and a content hash (no text travels).
2. Equal segments are counted before anything moves on.  A segment that occurs
   twice repeats in every window.  Anchors under which segments differ are mixed:
   one copy of each of their distinct segments is cut from the texts, for very
   frequent anchors in parts by two further anchors.
3. A shard's segments are suffix-sorted by induction; permuted common prefixes
   tell which windows repeat, within a segment or between segments.
4. Repeated windows return to their texts, whose covered bytes are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import text_kernels as tk
from strandlake.llm.sais import common_prefixes, suffix_array
from strandlake.llm.scratch import ship_package, stored

LENGTH = 400
GRAM = 32
_PLACE_BITS = 28
#: Bytes that are suffix-sorted at once; a shard takes several such arrays.
ARRAY_BYTES = 2 << 20
#: Distinct segments of one anchor from which its windows are dealt by two more anchors too.
HOT_SEGMENTS = 500
#: Bytes of a text that are looked at together; longer texts are taken in pieces that share all but one byte of a window.
PIECE_BYTES = 4 << 20
_SEPARATOR = 255  # in no UTF-8 text


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    base = 0xD1342543DE82EF95

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << int(n).bit_length()
            powers = []
            for base in (self.base, pow(self.base, -1, 1 << 64)):
                p = np.full(size, np.uint64(base))
                p[0] = 1
                powers.append(np.cumprod(p))
            self.up, self.down = powers
        return self.up, self.down


_POWERS = _Powers()
_GRAM_WEIGHTS = tk.hash_weights(8, 0x6124A)
_PLACES = np.uint64((1 << _PLACE_BITS) - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all ``gram``-byte strings (a power of two)."""
    h = data.astype(np.uint64) + np.uint64(1)
    step, k = 1, 0
    while step < gram:
        h = h[:-step] * _GRAM_WEIGHTS[k] + h[step:]
        step, k = step * 2, k + 1
    return tk.mix64(h)


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least (by its upper bits, then the first) of every ``width`` hashes in a row."""
    low = (h & ~_PLACES) | np.arange(len(h), dtype=np.uint64)
    least, span = low, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(low) - width + 1
    return (np.minimum(least[:n], least[width - span : width - span + n]) & _PLACES).astype(np.int64)


def segments(data: np.ndarray, doc_at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor: (doc, start in doc, windows, anchor key, content hash, anchor distance)."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    sizes = np.diff(doc_at)
    valid_docs = np.flatnonzero(sizes >= length)
    if len(valid_docs) == 0:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty
    if n > int(_PLACES):
        raise ValueError("too many bytes at once")
    h = gram_hashes(data, gram)
    anchor = least_places(h, length - gram + 1)
    windows = sizes[valid_docs] - length + 1
    at = tk.ranges(doc_at[:-1][valid_docs], windows)
    own = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    doc = np.searchsorted(doc_at, start, "right") - 1
    up, down = _POWERS.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    end = start + count + length - 1
    content = tk.mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return doc, start - doc_at[doc], count, h[own[first]], content, own[first] - start


def parts_of(segment: np.ndarray, distance: int, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(first window, part) of the runs of a segment's windows that share two more anchors.

    The anchors are the least grams under two other hashes, and where they stand
    from the segment's own: equal windows agree in all of that.
    """
    h, width = gram_hashes(segment, gram), length - gram + 1
    part = np.zeros(len(segment) - length + 1, np.uint64)
    for seed in (np.uint64(0x0DD1), np.uint64(0x0DD2)):
        at = least_places(tk.mix64(h ^ seed), width)
        part = tk.mix64(part + h[at] + (at - distance).astype(np.uint64) * seed)
    new = np.ones(len(part), bool)
    new[1:] = part[1:] != part[:-1]
    first = np.flatnonzero(new)
    return first, part[first].view(np.int64)


def _text_pieces(data: np.ndarray, at: np.ndarray, length: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first row, place in it) of pieces that together hold every window once."""
    if len(data) <= most:
        yield data, at, 0, 0
        return
    for row in range(len(at) - 1):  # a slice beyond the limit is one long text
        own = data[at[row] : at[row + 1]]
        for begin in range(0, max(len(own) - length + 1, 1), most):
            piece = own[begin : begin + most + length - 1]
            yield piece, np.array([0, len(piece)]), row, begin


def _find_segments(length: int):
    most = PIECE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                for data, at, first_row, begin in _text_pieces(*tk.flat_bytes(part.column("text")), length, most):
                    doc, start, count, key, content, distance = segments(data, at, length)
                    rows = pa.array(doc + first_row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.view(np.int64)),
                            pa.array(content.view(np.int64)),
                            part.column("text_a").take(rows),
                            part.column("text_b").take(rows),
                            pa.array(start + begin),
                            pa.array(count.astype(np.int32)),
                            pa.array(distance.astype(np.int32)),
                        ],
                        names=["key", "content", "text_a", "text_b", "start", "windows", "distance"],
                    )

    return run


def _cut(length: int):
    """Bytes of the wanted segments of each text; those of hot anchors in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tk.flat_bytes(batch.column("text"))
            rows, size = [], 0
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                for w in wanted:
                    begin, n = int(at[i]) + w["at"], w["windows"]
                    own = data[begin : begin + n + length - 1]
                    first, part = parts_of(own, w["distance"], length) if w["hot"] else (np.zeros(1, np.int64), np.zeros(1, np.int64))
                    for p, x, y in zip(part.tolist(), first.tolist(), [*first[1:].tolist(), n], strict=True):
                        rows.append((w["key"], p, w["content"], x, own[x : y + length - 1].tobytes()))
                        size += y - x + length - 1
                    if size > tk.SLICE_BYTES:
                        yield _segment_batch(rows)
                        rows, size = [], 0
            if rows:
                yield _segment_batch(rows)

    return run


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "part", "content", "skip", "bytes"])


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(text index, offset) of every window that starts in more than one place of the texts."""
    sizes = np.array([len(x) for x in texts], np.int64)
    t = np.frombuffer(bytes([_SEPARATOR]).join(texts), np.uint8)
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    room = np.zeros(len(t), np.int64)
    for i in range(len(texts)):
        room[at[i] : at[i] + sizes[i]] = np.arange(sizes[i], 0, -1)
    sa = suffix_array(t)
    long = common_prefixes(t, sa, room, length) >= length
    found = np.zeros(len(t), bool)
    found[sa[long]] = True
    found[sa[:-1][long[1:]]] = True
    place = np.flatnonzero(found)
    text = np.searchsorted(at, place, "right") - 1
    return text, place - at[text]


def _shares(rows: list[tuple], length: int, most: int) -> Iterator[list[tuple]]:
    """A large group's windows dealt by their content into shares of about ``most`` bytes, as rows of one window or few."""
    found = []
    for k, r in enumerate(rows):
        own = np.frombuffer(r[3], np.uint8)
        up, down = _POWERS.upto(len(own) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((own.astype(np.uint64) + np.uint64(1)) * up[: len(own)])))
        n = len(own) - length + 1
        found.append((np.full(n, k), np.arange(n), tk.mix64((sums[length:] - sums[:-length]) * down[:n])))
    row, place, share = (np.concatenate(x) for x in zip(*found, strict=True))
    share %= np.uint64(max(1, len(share) * length // most))
    order = np.argsort(share, kind="stable")
    row, place, share = row[order], place[order], share[order]
    for own in np.split(np.arange(len(order)), np.flatnonzero(share[1:] != share[:-1]) + 1):
        yield [(rows[k][0], rows[k][1], rows[k][2] + w, rows[k][3][w : w + length]) for k, w in zip(row[own].tolist(), place[own].tolist(), strict=True)]


def _sort_shard(length: int):
    """Suffix-sorts groups of one (key, part), several small ones together, a large one share after share."""
    most = ARRAY_BYTES

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        text, offset = repeated_windows([r[3] for r in rows], length)
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (offset[1:] != offset[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(text)))
        own = text[first]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in own], pa.int64()),
                pa.array([rows[i][1] for i in own], pa.int64()),
                pa.array((offset[first] + np.array([rows[i][2] for i in own], np.int64)).astype(np.int32), pa.int32()),
                pa.array(count.astype(np.int32)),
            ],
            names=["key", "content", "skip", "repeats"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, ready_size = [], 0  # whole groups
        rows, size, group = [], 0, None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal ready, ready_size, rows, size
            if size > 4 * most:
                for share in _shares(rows, length, most):
                    yield solve(share)
            else:
                if ready and ready_size + size > most:
                    yield solve(ready)
                    ready, ready_size = [], 0
                ready += rows
                ready_size += size
            rows, size = [], 0

        for batch in batches:
            for key, part, content, skip, text in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "content", "skip", "bytes")), strict=True):
                if (key, part) != group:
                    yield from close()
                    group = (key, part)
                rows.append((key, content, skip, text))
                size += len(text)
        yield from close()
        if ready:
            yield solve(ready)

    return run


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tk.flat_bytes(batch.column("text"))
            removed, spans, digests = [], [], []
            for i, found in enumerate(batch.column("found").to_pylist()):
                own = data[at[i] : at[i + 1]]
                start = np.array([x["at"] for x in found], np.int64)
                end = start + np.array([x["repeats"] for x in found], np.int64) + length - 1
                edge = np.zeros(len(own) + 1, np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, end, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
                digests.append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_a"), batch.column("text_b"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                names=["text_a", "text_b", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def repeated_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if it lies in a ``length``-byte string that starts in more than
    one place of all texts.  Null texts are empty; texts shorter than ``length``
    stay whole.  Repeated rows are repeats of each other.  A null doc_id is
    passed through.  An empty table gives no rows.  Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    named = rows.select("doc_id", "text", F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(7), "text").alias("text_b"))
    texts = named.select("text_a", "text_b", "text").where(F.octet_length("text") >= length)
    found = texts.mapInArrow(_find_segments(length), "key long, content long, text_a long, text_b long, start long, windows int, distance int")
    found = stored(found, "segments")

    where = F.struct("text_a", "text_b", "start", "windows", "distance")
    kinds = stored(found.groupBy("key", "content").agg(F.count("*").alias("copies"), F.min(where).alias("at")), "contents")
    per_key = kinds.groupBy("key").agg(F.count("*").alias("n_kinds")).where("n_kinds > 1")
    # equal windows are as far from their anchor, so none repeats within one segment
    wanted = kinds.join(per_key, "key").select("key", "content", "at", "n_kinds")
    repeats = stored(_solve(wanted, texts, length), "repeats")

    whole = kinds.where("copies > 1").select("key", "content", F.lit(0).alias("skip"), F.col("at.windows").alias("repeats"))
    runs = whole.unionByName(repeats)
    hits = found.join(runs, ["key", "content"]).select("text_a", "text_b", (F.col("start") + F.col("skip")).alias("at"), "repeats")
    per_text = hits.groupBy("text_a", "text_b").agg(F.collect_set(F.struct("at", "repeats")).alias("found"))
    changed = texts.join(per_text, ["text_a", "text_b"]).dropDuplicates(["text_a", "text_b"])
    changed = changed.select("text_a", "text_b", "text", "found").mapInArrow(_remove(length), "text_a long, text_b long, n_removed long, n_spans long, kept_sha256 string")
    changed = stored(changed, "changed")

    plain = named.select("doc_id", "text_a", "text_b", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    out = plain.join(changed, ["text_a", "text_b"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "own").alias("kept_sha256"),
    )


def _solve(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of one copy of each wanted segment: (key, content, skip, repeats).

    Segments of an anchor with many kinds are dealt by further anchors, which
    equal windows share, and those parts are sorted apart.
    """
    at = F.col("at")
    piece = F.struct("key", "content", at["start"].alias("at"), at["windows"].alias("windows"), at["distance"].alias("distance"), (F.col("n_kinds") > HOT_SEGMENTS).alias("hot"))
    per_text = wanted.groupBy(at["text_a"].alias("text_a"), at["text_b"].alias("text_b")).agg(F.collect_list(piece).alias("wanted"))
    bytes_ = texts.join(per_text, ["text_a", "text_b"]).dropDuplicates(["text_a", "text_b"]).select("text", "wanted")
    shards = bytes_.mapInArrow(_cut(length), "key long, part long, content long, skip int, bytes binary")
    shards = shards.repartition("key", "part").sortWithinPartitions("key", "part")
    return shards.mapInArrow(_sort_shard(length), "key long, content long, skip int, repeats int")
