"""Operator 3: token ids in binary shards with Elias-Fano document boundaries.

A shard file holds documents in ascending doc_id order:

    magic "SLTK", version u16, id bytes u16, documents u64, documents without a
    doc_id u64, ids u64, least doc_id i64, then
    Elias-Fano of doc_id minus the least, Elias-Fano of the ends of documents,
    the concatenated ids (2 or 4 bytes each, little-endian).

A manifest table names the committed shards; a task that runs twice writes two
files, of which only the committed one is named.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm import text_kernels as tk
from strandlake.llm.elias_fano import EliasFano
from strandlake.llm.pieces import byte_pieces, special_splitter
from strandlake.llm.scratch import dealt, new_folder, ship_file, ship_package, shipped, stored

END_ID = 2
#: Distinct pieces a worker remembers; beyond it, it begins anew.
MEMO_PIECES = 3_000_000
#: Ids of a shard at most; a task begins another shard beyond it.
SHARD_IDS = 1 << 23
_HEADER = "<4sHHQQQq"


class _Memo:
    """Ids of pieces by hash: sorted hashes, and each one's slice of a growing id buffer."""

    def __init__(self, kind: np.dtype):
        self.hash = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, kind), 0

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hash, hashes)
        inside = at < len(self.hash)
        known = np.zeros(len(hashes), bool)
        known[inside] = self.hash[at[inside]] == hashes[inside]
        return np.flatnonzero(~known)

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New entries; ``hashes`` ascend."""
        if self.used + len(ids) > len(self.ids):
            grown = np.zeros(2 * (self.used + len(ids)), self.ids.dtype)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.hash, hashes)
        self.hash = np.insert(self.hash, at, hashes)
        self.slot = np.insert(self.slot, at, self.used + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, at, sizes)
        self.used += len(ids)

    def slices(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hash, hashes)
        return self.slot[at], self.size[at].astype(np.int64)


class PieceCoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece once."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(vocabulary)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.specials = {t.content: i for i, t in self.plain.get_added_tokens_decoder().items()}
        self.split = special_splitter(list(self.specials)) if self.specials else None
        self.plain.encode_special_tokens = True  # texts come without their strings
        self.kind = np.dtype("<u4" if self.plain.get_vocab_size() > 1 << 16 else "<u2")
        vocab = self.plain.get_vocab(with_added_tokens=False)
        self.token_bytes = np.zeros(self.plain.get_vocab_size() + 1, np.int64)
        for token, i in vocab.items():  # a byte-level token has a character for each byte
            self.token_bytes[i] = len(token)
        self.memo = _Memo(self.kind)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of texts)."""
        pieces, owner = [], []
        for k, t in enumerate(texts):
            own = self.split.split(t) if self.split and "<|" in t else [t]
            pieces.extend(own)
            owner.extend([k] * len(own))
        special = [k for k, p in enumerate(pieces) if p in self.specials] if len(pieces) > len(texts) else []
        ids, at = self._encode_plain([p if len(special) == 0 or p not in self.specials else "" for p in pieces])
        if len(pieces) == len(texts):
            return ids, at
        sizes = np.diff(at)
        marks = np.array([self.specials[pieces[k]] for k in special], self.kind)
        ids = np.insert(ids, at[:-1][special], marks) if special else ids
        sizes[special] = 1
        total = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(total)))

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, start, end = byte_pieces(texts)
        at = np.searchsorted(start, flat.at)
        if len(start) == 0:
            return np.zeros(0, self.kind), np.zeros(len(texts) + 1, np.int64)
        hashes, first, inverse = np.unique(tk.span_hashes(flat.points, start, end), return_index=True, return_inverse=True)
        if len(self.memo.hash) > MEMO_PIECES:
            self.memo = _Memo(self.kind)
        new = self.memo.missing(hashes)
        if len(new):
            self.memo.add(hashes[new], *self._encode_pieces(flat, start[first[new]], end[first[new]]))
        slot, size = self.memo.slices(hashes)
        per_piece = size[inverse]
        ids = self.memo.ids[tk.ranges(slot[inverse], per_piece)]
        return ids, np.concatenate(([0], np.cumsum(per_piece)))[at]

    def _encode_pieces(self, flat: tk.CodePoints, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece) from the library.

        Blank-and-letters pieces go in as running text, which the library splits
        before each blank; the bytes of their ids tell where they end.  Others go
        in one by one.
        """
        points, n = flat.points, len(start)
        second = np.minimum(start + 1, len(points) - 1)
        plain = (end - start > 1) & (points[start] == 32) & (tk.point_classes()[points[second]] == tk.LETTER)
        words = [flat.text[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        sizes = np.zeros(n, np.int64)
        joined = np.flatnonzero(plain)
        parts: list[np.ndarray] = []
        for k in range(0, len(joined), 2000):
            own = [words[i] for i in joined[k : k + 2000].tolist()]
            ids = np.array(self.plain.encode_batch_fast(["".join(own)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum([len(w.encode()) for w in own])) + 1
            sizes[joined[k : k + 2000]] = np.diff(ends, prepend=0)
            parts.append(ids)
        other = np.flatnonzero(~plain)
        coded = [c.ids for c in self.plain.encode_batch_fast([words[i] for i in other.tolist()], add_special_tokens=False)] if len(other) else []
        sizes[other] = [len(c) for c in coded]
        table = np.concatenate([*parts, np.array([i for c in coded for i in c], self.kind)])
        order = np.concatenate((joined, other))
        begin = np.zeros(n, np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return table[tk.ranges(begin, sizes)], sizes


_coders: dict[str, PieceCoder] = {}


def coder_of(vocabulary: str) -> PieceCoder:
    if vocabulary not in _coders:
        _coders[vocabulary] = PieceCoder(vocabulary)
    return _coders[vocabulary]


def shard_bytes(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard's file content; doc_ids ascend, nulls first."""
    named = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(named[0]) if len(named) else 0
    shifted = (named.view(np.uint64) - np.int64(least).view(np.uint64)) if len(named) else named.view(np.uint64)
    head = struct.pack(_HEADER, b"SLTK", 1, ids.dtype.itemsize, len(doc_ids), len(doc_ids) - len(named), len(ids), least)
    return head + EliasFano.build(shifted).to_bytes() + EliasFano.build(np.cumsum(sizes)).to_bytes() + ids.tobytes()


class Shard:
    """A shard read back: random access by rank through select."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, version, width, self.n_docs, self.n_unnamed, self.n_ids, self.least = struct.unpack_from(_HEADER, view)
        if magic != b"SLTK" or version != 1:
            raise ValueError("not a token shard")
        at = struct.calcsize(_HEADER)
        self.names, size = EliasFano.from_bytes(view[at:])
        at += size
        self.ends, size = EliasFano.from_bytes(view[at:])
        at += size
        self.ids = np.frombuffer(view[at : at + width * self.n_ids], f"<u{width}")

    def doc_ids(self) -> list[int | None]:
        named = self.names.select(np.arange(self.names.n)) + np.int64(self.least).view(np.uint64)
        return [None] * self.n_unnamed + named.view(np.int64).tolist()

    def bounds(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of documents within the shard's ids."""
        ends = self.ends.select(ranks).astype(np.int64)
        starts = np.zeros(len(ranks), np.int64)
        later = np.flatnonzero(np.asarray(ranks) > 0)
        starts[later] = self.ends.select(np.asarray(ranks)[later] - 1).astype(np.int64)
        return starts, ends

    def tokens(self, rank: int) -> np.ndarray:
        (start,), (end,) = self.bounds(np.array([rank]))
        return self.ids[start:end]


def _write(folder: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        coder, part, number = coder_of(shipped(vocabulary)), TaskContext.get().partitionId(), 0
        doc_ids, sizes, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, doc_ids, sizes, ids, held
            name = f"{base}/shard-{part:06d}-{number:04d}-{uuid.uuid4().hex}.sltk"
            with files.open_output_stream(name) as f:
                f.write(shard_bytes(doc_ids, np.concatenate(sizes), np.concatenate(ids)))
            row = {"part": [part], "number": [number], "file": [name.rsplit("/", 1)[1]], "n_docs": [len(doc_ids)], "n_ids": [held]}
            number, doc_ids, sizes, ids, held = number + 1, [], [], [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for piece in tk.slices(batch, limit=tk.SLICE_BYTES):
                own, at = coder.encode(tk.text_column(piece.column("text")).to_pylist())
                ends = at[1:]
                ids.append(np.insert(own, ends, np.array(end_id, coder.kind)))
                sizes.append(np.diff(at) + 1)
                doc_ids.extend(piece.column("doc_id").to_pylist())
                held += len(ids[-1])
                if held >= SHARD_IDS:
                    yield flush()
        if doc_ids:
            yield flush()

    return run


def write_token_store(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode all texts into shards in ``folder`` (any URI that pyarrow opens); returns the stored manifest.

    manifest: part, number (shards in order), file, n_docs, n_ids, first_id (ids of all shards before).
    A null text is empty (it has its end id); null doc_ids come first; repeated
    rows stay, in the order of their texts; an empty table has no shards.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = stored(ordered.mapInArrow(_write(folder, ship_file(docs.sparkSession, vocabulary), end_id), "part long, number long, file string, n_docs long, n_ids long"), "shards")
    # one row a shard: the running sum needs one task and few rows
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return stored(written.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))), "manifest")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first_id").to_pylist(), strict=True):
                with files.open_input_file(f"{base}/{name}") as f:
                    shard = Shard(f.read())
                start, end = shard.bounds(np.arange(shard.n_docs))
                digests = [zlib.crc32(shard.ids[s:e].astype("<u4").tobytes()) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids(), pa.int64()), pa.array(start + first), pa.array(end - start), pa.array(digests, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_token_store(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shard files."""
    shards = dealt(manifest.select("file", "first_id"))
    return shards.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    folder = new_folder(spark, "tokens")
    return read_token_store(write_token_store(docs, vocabulary, folder), folder)
