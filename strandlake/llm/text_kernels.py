"""NumPy kernels over whole Arrow batches of texts.

Every kernel works on flat arrays (bytes or code points of many documents, with
document offsets), in slices of a bounded number of bytes, so that a worker's
memory does not depend on the batch size Spark chose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def hash_weights(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit multipliers, the same for any n."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


class _Weights:
    """A growing multiplier table: weights of longer words extend, never change."""

    def __init__(self, seed: int):
        self.seed, self.table = seed, hash_weights(256, seed)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            self.table = hash_weights(1 << int(n - 1).bit_length(), self.seed)
        return self.table


_BYTE_WEIGHTS = _Weights(0x5EED)


def text_column(column: pa.Array) -> pa.Array:
    """Text as Arrow strings, null read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all rows, row offsets into them)."""
    column = text_column(column)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with at most ``limit`` text bytes each (or one row)."""
    _, at = flat_bytes(batch.column(column))
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` for all pairs."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of many documents.

    start, end: byte bounds in the flat buffer; at: word offsets of documents;
    hash: 64-bit hash of each word's bytes, A-Z lower-cased when ``lower``.
    """

    def __init__(self, data: np.ndarray, doc_at: np.ndarray, lower: bool = True):
        n = len(data)
        self.n_docs = len(doc_at) - 1
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.zeros(n + 1, bool)
        edge[doc_at] = True
        word = ~space
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = word[:-1]
        begins = word & (~before | edge[:-1])
        self.start = np.flatnonzero(begins)
        after = np.empty(n, bool)
        after[n - 1 :] = False
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.at = np.searchsorted(self.start, doc_at)
        chars = data[word]
        if lower:
            chars = np.where((chars >= 65) & (chars <= 90), chars + 32, chars)
        size = self.end - self.start
        place = ranges(np.zeros(len(size), np.int64), size)
        weights = _BYTE_WEIGHTS.upto(int(size.max()) if len(size) else 1)
        sums = np.zeros(len(chars) + 1, U64)
        np.cumsum((chars.astype(U64) + U64(1)) * weights[place], out=sums[1:])
        ends = np.cumsum(size)
        self.hash = mix64(sums[ends] - sums[ends - size]) if len(size) else np.zeros(0, U64)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)


_SHINGLE_WEIGHTS = hash_weights(64, 0x51AB)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document offsets) of all ``width``-word shingles, with repeats.

    A document of 1 to width-1 words has one: its whole sequence.
    """
    h, count = words.hash, words.counts()
    n_out = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(n_out))).astype(np.int64)
    out = np.zeros(int(at[-1]), U64)
    full = np.flatnonzero(count >= width)
    if len(full):
        first = ranges(words.at[full], n_out[full])
        acc = np.zeros(len(first), U64)
        for k in range(width):
            acc += h[first + k] * _SHINGLE_WEIGHTS[k]
        out[ranges(at[full], n_out[full])] = mix64(acc + U64(width))
    for d in np.flatnonzero((count > 0) & (count < width)):
        own = h[words.at[d] : words.at[d + 1]]
        out[at[d]] = mix64(np.array([(own * _SHINGLE_WEIGHTS[: len(own)]).sum() + U64(len(own))], U64))[0]
    return out, at


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, document offsets) of an Arrow text column."""
    words = Words(*flat_bytes(column))
    h, at = shingles(words, width)
    if len(h) == 0:
        return h, at
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(at)))


class CodePoints:
    """Code points of many strings, flat."""

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        self.points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


_POINT_WEIGHTS = _Weights(0xC0DE)


def span_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each code-point span; spans ascend and do not overlap."""
    size = end - start
    chars = points[ranges(start, size)].astype(U64) + U64(1)
    weights = _POINT_WEIGHTS.upto(int(size.max()) if len(size) else 1)
    sums = np.zeros(len(chars) + 1, U64)
    np.cumsum(chars * weights[ranges(np.zeros(len(size), np.int64), size)], out=sums[1:])
    ends = np.cumsum(size)
    return mix64(sums[ends] - sums[ends - size] + size.astype(U64)) if len(size) else np.zeros(0, U64)


#: Classes of code points for pre-tokenisers.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_classes: np.ndarray | None = None


def point_classes() -> np.ndarray:
    """Class of each code point, from the Unicode data of the ``regex`` library."""
    global _classes
    if _classes is None:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                s, e = ord(m[0][0]), ord(m[0][-1])
                table[s : e + 1] = kind
        _classes = table
    return _classes
