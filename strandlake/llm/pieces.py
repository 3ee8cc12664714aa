"""Vectorised pre-tokenisers: the splits of two public byte-pair encodings over whole batches.

Both return spans of code points.  They give what the tokenizers' patterns give,
from runs of one character class; special-token strings must be cut out before.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from strandlake.llm.text_kernels import LETTER, NUMBER, OTHER, SPACE, CodePoints, point_classes

#: The contractions that both patterns split off, after an apostrophe.
_ONE = np.array([ord(c) for c in "stmd"], np.uint32)
_TWO = [(ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l"))]


def _contraction(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letters that belong to the apostrophe at each place: 0, 1 or 2."""
    last = len(points) - 1
    x, y = points[np.minimum(at + 1, last)], points[np.minimum(at + 2, last)]
    two = np.zeros(len(at), bool)
    for p, q in _TWO:
        two |= (x == p) & (y == q) & (at + 2 <= last)
    one = np.isin(x, _ONE) & (at + 1 <= last)
    return np.where(one, 1, np.where(two, 2, 0))


def _runs(kind: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of runs of one class that cross no break."""
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[breaks[breaks < len(kind)]] = True
    start = np.flatnonzero(new)
    return start, np.append(start[1:], len(kind))


def lowered(text: str) -> str:
    """Composed (NFC) and lower-cased character by character."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    # one character at a time, a capital sigma has no final form
    return text.replace("Σ", "σ").lower()


def word_pieces(texts: list[str]) -> tuple[CodePoints, np.ndarray, np.ndarray]:
    """Pieces of lower-casing word encodings: contractions, letter runs, single digits, other runs.

    White space is dropped.  Returns the (already lowered) texts' code points and piece bounds.
    """
    flat = CodePoints(texts)
    points = flat.points
    if len(points) == 0:
        return flat, np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = point_classes()[points]
    start, end = _runs(kind, flat.at[:-1])
    own = kind[start]
    # single digits
    many = np.flatnonzero((own == NUMBER) & (end - start > 1))
    if len(many):
        extra = np.concatenate([np.arange(start[r] + 1, end[r]) for r in many])
        start = np.sort(np.concatenate((start, extra)))
        end = np.append(start[1:], len(points))
        own = kind[start]
    quote = np.flatnonzero((own == OTHER) & (points[start] == ord("'")) & (end - start == 1))
    quote = quote[quote + 1 < len(start)]
    quote = quote[(own[quote + 1] == LETTER) & ~np.isin(end[quote], flat.at)]
    size = np.minimum(_contraction(points, start[quote]), end[quote + 1] - start[quote + 1])
    # a two-letter form needs both letters in the run
    start, end = start.copy(), end.copy()
    end[quote] += size
    start[quote + 1] += size
    keep = (own != SPACE) & (start < end)
    return flat, start[keep], end[keep]


def byte_pieces(texts: list[str]) -> tuple[CodePoints, np.ndarray, np.ndarray]:
    """Pieces of space-keeping byte-level encodings; they cover every character."""
    flat = CodePoints(texts)
    points = flat.points
    if len(points) == 0:
        return flat, np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = point_classes()[points]
    start, end = _runs(kind, flat.at[:-1])
    own = kind[start]
    n = len(start)
    doc_end = np.isin(end, flat.at)
    space = (own == SPACE) & ~doc_end
    blank = points[end - 1] == 32
    # a white-space run before a word: its last character goes alone, or to the word if it is a blank
    give = np.flatnonzero(space)
    attach = np.zeros(n, bool)
    attach[give[blank[give]] + 1] = True
    alone = give[~blank[give] & (end[give] - start[give] > 1)]
    new_start = np.where(attach, start - 1, start)
    new_end = end.copy()
    new_end[give[blank[give]]] -= 1
    new_end[alone] -= 1
    quote = np.flatnonzero((own == OTHER) & ~attach & (points[start] == ord("'")) & (end - start == 1) & ~doc_end)
    quote = quote[quote + 1 < n]
    quote = quote[own[quote + 1] == LETTER]
    size = np.minimum(_contraction(points, start[quote]), end[quote + 1] - start[quote + 1])
    new_end[quote] += size
    new_start[quote + 1] += size
    starts = np.concatenate((new_start, end[alone] - 1))
    ends = np.concatenate((new_end, end[alone]))
    keep = starts < ends
    starts, ends = starts[keep], ends[keep]
    order = np.argsort(starts, kind="stable")
    return flat, starts[order], ends[order]


def special_splitter(specials: list[str]) -> re.Pattern:
    """Splits a text at special-token strings, which are kept as odd parts."""
    return re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")")
