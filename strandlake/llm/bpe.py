"""Operator 4: byte-pair encoding and decoding with a transducer lexicon of frequent words.

1. Words of all documents are counted.
2. The most frequent ones are compiled, with the ids that exact merging gives
   them, into a minimal acyclic transducer, one file that every worker maps.
3. Documents are cut into words by vectorised rules; each batch's distinct words
   walk the transducer together, and those it lacks are merged exactly.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import text_kernels as tk
from strandlake.llm.pieces import lowered, special_splitter, word_pieces
from strandlake.llm.lexicon import Lexicon
from strandlake.llm.scratch import put_file, ship_file, ship_package, shipped

LEXICON_WORDS = 1 << 16
#: Merged words that a worker remembers; beyond it, it begins anew.
MEMO_WORDS = 100_000


def byte_alphabet() -> list[str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable ones
    stand for themselves, the others take the code points from 256 on, in order."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b) if b in own else chr(256 + n))
        n += b not in own
    return out


class WordBPE:
    """The merges of a word-end byte-pair vocabulary file (JSON of the tokenizers library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: k for k, pair in enumerate(merges)}
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.tokens.update({i: t for t, i in self.specials.items()})
        self.alphabet = byte_alphabet()

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the adjacent pair of least rank is merged, leftmost first, until none is known."""
        parts = [self.alphabet[b] for b in word.encode("utf-8")]
        parts[-1] += self.suffix
        ranks, none = self.ranks, len(self.ranks)
        costs = [ranks.get(p, none) for p in zip(parts, parts[1:], strict=False)]
        if len(parts) > 64:
            return self._merge_long(parts)
        while costs and (low := min(costs)) < none:
            k = costs.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del costs[k]
            if k:
                costs[k - 1] = ranks.get((parts[k - 1], parts[k]), none)
            if k < len(costs):
                costs[k] = ranks.get((parts[k], parts[k + 1]), none)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def _merge_long(self, parts: list[str]) -> list[int]:
        """The same with a queue of pairs, for words of any length."""
        import heapq

        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        gone = bytearray(n)
        queue = []

        def push(k: int) -> None:
            if k >= 0 and after[k] < n and (r := self.ranks.get((parts[k], parts[after[k]]))) is not None:
                heapq.heappush(queue, (r, k, parts[k], parts[after[k]]))

        for k in range(n):
            push(k)
        while queue:
            _, k, x, y = heapq.heappop(queue)
            if gone[k] or after[k] >= n or parts[k] != x or parts[after[k]] != y:
                continue
            other = after[k]
            parts[k] += parts[other]
            gone[other] = 1
            after[k] = after[other]
            if after[k] < n:
                before[after[k]] = k
            push(before[k])
            push(k)
        return [self.vocab[p] for k, p in enumerate(parts) if not gone[k] and p in self.vocab]


_models: dict[str, WordBPE] = {}
_coders: dict[tuple[str, str], WordCoder] = {}


def model_of(path: str) -> WordBPE:
    if path not in _models:
        _models[path] = WordBPE(path)
    return _models[path]


class _Normaliser:
    """Lower-casing as the vocabulary file says; characters newer than Python's tables go to the library."""

    def __init__(self, path: str):
        import unicodedata

        self.path, self.library = path, None
        self.new = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])

    def __call__(self, texts: list[str]) -> list[str]:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not self.new[points].any():
            return [lowered(t) for t in texts]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).normalizer
        return [self.library.normalize_str(t) for t in texts]


_normalisers: dict[str, _Normaliser] = {}


def normaliser(path: str) -> _Normaliser:
    if path not in _normalisers:
        _normalisers[path] = _Normaliser(path)
    return _normalisers[path]


def distinct_spans(points: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(first place of each distinct span, each span's distinct number, counts)."""
    _, first, inverse, counts = np.unique(tk.span_hashes(points, start, end), return_index=True, return_inverse=True, return_counts=True)
    return first, inverse.reshape(-1), counts


class WordCoder:
    """Encodes and decodes texts with a lexicon and, for the rest, exact merges."""

    def __init__(self, vocabulary: str, lexicon: Lexicon):
        self.model, self.lexicon = model_of(vocabulary), lexicon
        self.normal = normaliser(vocabulary)
        self.split = special_splitter(list(self.model.specials))
        self.known: dict[int, tuple] = {}
        self.memo: dict[str, tuple] = {}

    def entry(self, ids: list[int]) -> tuple[int, str, str]:
        """(number of ids, decimal ids, decoded tokens), the latter joined by spaces."""
        return len(ids), " ".join(map(str, ids)), " ".join(self.model.tokens[i] for i in ids)

    def encode_words(self, texts: list[str]):
        """(entries of distinct words, each word's entry, word offsets of texts)."""
        flat, start, end = word_pieces(self.normal(texts))
        at = np.searchsorted(start, flat.at)
        if len(start) == 0:
            return [], np.zeros(0, np.int64), at
        first, inverse, _ = distinct_spans(flat.points, start, end)
        ranks = self.lexicon.ranks(flat.points, start[first], end[first]).tolist()
        entries, text = [], flat.text
        for rank, s, e in zip(ranks, start[first].tolist(), end[first].tolist(), strict=True):
            if rank >= 0:
                got = self.known.get(rank)
                if got is None:
                    got = self.known[rank] = self.entry(self.lexicon.ids_of(rank))
            else:
                word = text[s:e]
                got = self.memo.get(word)
                if got is None:
                    if len(self.memo) >= MEMO_WORDS:
                        self.memo.clear()
                    got = self.memo[word] = self.entry(self.model.merge(word))
            entries.append(got)
        return entries, inverse, at

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, decimal ids, decoded text) of each text."""
        parts = [self.split.split(t) if "<|" in t else [t] for t in texts]
        entries, words, at = self.encode_words([p for own in parts for p in own[::2]])
        counts = np.array([e[0] for e in entries] or [0], np.int64)
        per_word = counts[words] if len(words) else np.zeros(0, np.int64)
        ids, shown = np.array([e[1] for e in entries], object), np.array([e[2] for e in entries], object)
        sums = np.concatenate(([0], np.cumsum(per_word)))
        k = 0
        for own in parts:
            if len(own) == 1:
                used = words[at[k] : at[k + 1]]
                yield int(sums[at[k + 1]] - sums[at[k]]), " ".join(ids[used].tolist()), " ".join(shown[used].tolist())
                k += 1
                continue
            n, x, y = 0, [], []
            for i, p in enumerate(own):
                if i % 2:
                    n, x, y = n + 1, [*x, str(self.model.specials[p])], [*y, p]
                else:
                    used = words[at[k] : at[k + 1]]
                    n, x, y = n + int(sums[at[k + 1]] - sums[at[k]]), x + ids[used].tolist(), y + shown[used].tolist()
                    k += 1
            yield n, " ".join(x), " ".join(y)


def coder_of(vocabulary: str, file: str) -> WordCoder:
    """This worker's coder for a vocabulary and a lexicon that were shipped to it."""
    if (vocabulary, file) not in _coders:
        _coders.clear()
        _coders[vocabulary, file] = WordCoder(shipped(vocabulary), Lexicon.mapped(shipped(file)))
    return _coders[vocabulary, file]


def _count_words(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = shipped(vocabulary)
        normal, split = normaliser(path), special_splitter(list(model_of(path).specials))
        for batch in batches:
            for part in tk.slices(batch, limit=4 * tk.SLICE_BYTES):
                texts = tk.text_column(part.column("text")).to_pylist()
                texts = [p for t in texts for p in (split.split(t)[::2] if "<|" in t else [t])]
                flat, start, end = word_pieces(normal(texts))
                if len(start) == 0:
                    continue
                first, _, counts = distinct_spans(flat.points, start, end)
                words = [flat.text[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], names=["word", "n"])

    return run


def word_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(word, n) over all texts."""
    rows = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(_count_words(ship_file(docs.sparkSession, vocabulary)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str, size: int = LEXICON_WORDS) -> str:
    """Compile the ``size`` most frequent words; returns the name under which Spark ships the file.

    The lexicon has a fixed size and is only a faster way: it never decides an id.
    """
    spark = docs.sparkSession
    model = model_of(vocabulary)
    frequent = word_counts(docs, vocabulary).orderBy(F.desc("n"), "word").limit(size)
    entries = {r.word: model.merge(r.word) for r in frequent.toLocalIterator()}
    return put_file(spark, "lexicon", Lexicon.compile(entries).to_bytes())


def _encode(vocabulary: str, file: str, texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(vocabulary, file)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for part in tk.slices(batch, limit=2 * tk.SLICE_BYTES):
                texts = tk.text_column(part.column("text")).to_pylist()
                n, ids, shown = [], [], []
                for k, x, y in coder.encode(texts):
                    n.append(k)
                    ids.append([int(i) for i in x.split()] if texts_too else sha(x))
                    shown.append(y if texts_too else sha(y))
                names = ["doc_id", "n_tokens", "ids", "decoded"] if texts_too else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                kind = pa.list_(pa.int32()) if texts_too else pa.string()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(shown, pa.string())], names=names)

    return run


def encode_documents(docs: DataFrame, vocabulary: str, lexicon: str | None = None, digests: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, and ids and decoded text (or their SHA-256 digests).

    As the tokenizers library encodes without added special tokens (their strings
    in a text are recognised) and decodes with them.  A null text is empty: no
    ids.  Null doc_ids and repeated rows pass through; other columns are ignored;
    an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    file = lexicon or build_lexicon(docs, vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return rows.mapInArrow(_encode(ship_file(spark, vocabulary), file, not digests), schema)


