"""Suffix arrays of byte strings by induced sorting, and their permuted common prefixes.

The byte level is vectorised: a bucket's entries are moved at once, generation by
generation, which visits them in the order of the sequential scan.  Names of
leftmost-smaller substrings are sorted by recursion; there, where a bucket holds
few entries, groups are split symbol by symbol up to the next such substring,
whose rank the recursion has found.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S type); the last is L."""
    n = len(t)
    step = np.full(n, -1, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
    place = np.where(step != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(place[::-1])[::-1]
    return step[following] > 0


def _split(values: np.ndarray, chars: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append ``values`` to the lists of their characters, keeping their order."""
    if len(values) == 0:
        return
    order = np.argsort(chars, kind="stable")
    values = values[order]
    sizes = np.bincount(chars, minlength=256)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for c in np.flatnonzero(sizes):
        into[c].append(values[at[c] : at[c + 1]])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.int64)


def _chain(t: np.ndarray, front: np.ndarray, c: int) -> np.ndarray:
    """``front`` and, generation by generation, the predecessors with the same character."""
    parts = [front]
    while len(front):
        front = front[front > 0] - 1
        front = front[t[front] == c]
        parts.append(front)
    return _joined(parts)


def _induce(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order."""
    n = len(t)
    by_char: list[list[np.ndarray]] = [[] for _ in range(256)]
    _split(lms, t[lms], by_char)
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger[t[n - 1]].append(np.array([n - 1]))
    l_sorted: list[np.ndarray] = []
    for c in range(256):
        own = _chain(t, _joined(larger[c]), c)
        l_sorted.append(own)
        scanned = np.concatenate((own, _joined(by_char[c])))
        scanned = scanned[scanned > 0] - 1
        chars = t[scanned]
        up = chars > c
        _split(scanned[up], chars[up], larger)
    smaller: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * 256
    for c in range(255, -1, -1):
        own = _chain(t, _joined(smaller[c]), c)
        out[c] = np.concatenate((l_sorted[c], own[::-1]))
        scanned = np.concatenate((own, l_sorted[c][::-1]))
        scanned = scanned[scanned > 0] - 1
        chars = t[scanned]
        down = chars < c
        _split(scanned[down], chars[down], smaller)
    return np.concatenate(out)


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of leftmost-smaller substrings in text order, equal for equal ones, and their number."""
    n = len(t)
    size = np.zeros(n, np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    x, y = ordered[:-1], ordered[1:]
    same = (size[x] == size[y]) & (size[x] > 0)
    live, k = np.flatnonzero(same), 0
    while len(live):
        differ = t[x[live] + k] != t[y[live] + k]
        same[live[differ]] = False
        k += 1
        live = live[~differ]
        live = live[size[x[live]] > k]
    name = np.concatenate(([0], np.cumsum(~same)))
    at = np.zeros(n, np.int64)
    at[ordered] = name
    return at[lms], int(name[-1]) + 1


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of a uint8 array; a shorter suffix that is a prefix of another is smaller."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    s_type = _types(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = _induce(t, lms)
        ordered = ordered[is_lms[ordered]]
        name, kinds = _names(t, lms, ordered)
        lms = ordered if kinds == len(lms) else lms[_sort_names(name, kinds)]
    return _induce(t, lms)


def _refined(first: np.ndarray, last: np.ndarray, symbol: np.ndarray, ends: np.ndarray | None) -> np.ndarray:
    """Ranks of the substrings first..last of ``symbol``, then of their ends; equal ones share a rank.

    Groups that agree so far are split by their next symbol until they part or end.
    """
    rank = np.zeros(len(first), np.int64)
    live = np.arange(len(first))
    depth = 0
    while len(live) > 1:
        at = first[live] + depth
        inside = at <= last[live]
        value = np.where(inside, symbol[np.minimum(at, len(symbol) - 1)] + 1, 0 if ends is None else ends[live] + 1)
        order = np.argsort((rank[live] << 32) | value, kind="stable")
        live, value, inside = live[order], value[order], inside[order]
        own = rank[live]
        new = np.ones(len(live), bool)
        new[1:] = own[1:] != own[:-1]
        block = np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))
        new[1:] |= value[1:] != value[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))
        rank[live] = own + head - block
        alone = new & np.append(new[1:], True)
        live = live[~alone & inside]
        depth += 1
    return rank


def _sort_names(s: np.ndarray, kinds: int) -> np.ndarray:
    """Suffix array of an integer string, values 0..kinds-1, by recursion on leftmost-smaller substrings."""
    n = len(s)
    if kinds == n:
        return np.argsort(s)
    step = np.full(n, -1, np.int8)
    step[:-1] = np.sign(s[1:] - s[:-1])
    place = np.where(step != 0, np.arange(n), n - 1)
    small = step[np.minimum.accumulate(place[::-1])[::-1]] > 0
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    symbol = 2 * s + small
    until = np.full(n, n - 1, np.int64)
    ends = np.full(n, -1, np.int64)
    if len(lms):
        following = np.append(lms[1:], n - 1)
        rank = _refined(lms, following, symbol, np.append(np.zeros(len(lms) - 1, np.int64), -1))
        names, name = np.unique(rank, return_inverse=True)
        order = _sort_names(name.reshape(-1), len(names))
        rank = np.empty(len(lms), np.int64)
        rank[order] = np.arange(len(lms))
        own = np.searchsorted(lms, np.arange(n), "right")
        has = own < len(lms)
        until[has] = lms[own[has]]
        ends[has] = rank[own[has]]
    return np.argsort(_refined(np.arange(n), until, symbol, ends))


def common_prefixes(t: np.ndarray, sa: np.ndarray, room: np.ndarray, most: int) -> np.ndarray:
    """Common prefix lengths of neighbours in ``sa`` (0 for the first), up to ``most``.

    room: how far each position may reach; a prefix is cut to the lesser room.
    Lengths are found in text order.  One that follows from its left neighbour's
    (equal preceding characters, which have room) is that less one; only others
    are compared.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    reducible = np.zeros(n, bool)
    k = i[1:][(before[1:] > 0) & (before[:-1] >= 0)]
    reducible[k] = (t[k - 1] == t[before[k] - 1]) & (before[k - 1] == before[k] - 1) & (room[k - 1] > 0)
    start = np.flatnonzero(~reducible & (before >= 0))
    length = np.zeros(n, np.int64)
    word = np.ndarray((n + 1,), "<u8", np.concatenate((t, np.zeros(9, np.uint8))), strides=(1,))
    live, at = start, np.zeros(len(start), np.int64)
    reach = np.minimum(n - np.maximum(start, before[start]), np.minimum(room[start], room[before[start]]))
    index = np.arange(len(start))
    while len(live):
        done = at[index]
        differ = word[live + done] ^ word[before[live] + done]
        lowest = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.log2(np.maximum(lowest, 1).astype(np.float64)).astype(np.int64) >> 3)
        at[index] = np.minimum(done + equal, reach[index])
        more = (equal == 8) & (at[index] < reach[index])
        live, index = live[more], index[more]
    length[start] = at
    anchor = np.maximum.accumulate(np.where(reducible, -1, i))
    derived = np.flatnonzero(reducible & (anchor >= 0))
    length[derived] = np.maximum(length[anchor[derived]] - (derived - anchor[derived]), 0)
    out = np.zeros(n, np.int64)
    out[1:] = np.minimum(length[sa[1:]], most)
    out[1:] = np.minimum(out[1:], np.minimum(room[sa[1:]], room[sa[:-1]]))
    return out
