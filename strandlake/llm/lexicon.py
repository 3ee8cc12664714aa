"""A minimal acyclic transducer from words to token ids, in flat arrays that are memory-mapped.

Words are added in order; finished suffixes are merged with equal ones, so the
automaton is minimal.  A transition's output is the number of words that come
before those behind it: the outputs on a word's path add up to its rank, which
finds its ids in one table.
"""

from __future__ import annotations

import os

import numpy as np

from strandlake.llm.text_kernels import ranges

_ARRAYS = ("keys", "targets", "outputs", "final", "offsets", "ids")


class Lexicon:
    """keys: state << 21 | code point, ascending; targets, outputs: per key; final: per state."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        for name in _ARRAYS:
            setattr(self, name, arrays[name])

    @classmethod
    def compile(cls, entries: dict[str, list[int]]) -> Lexicon:
        """The lexicon of the given words and their ids."""
        words = sorted(entries)
        registry: dict[tuple, int] = {}
        numbered: list[tuple[bool, tuple]] = []  # state: final?, ((label, state), ...)

        def freeze(node: list) -> int:
            """Number of the state equal to this finished node."""
            key = (node[0], tuple(node[1]))
            if key not in registry:
                registry[key] = len(numbered)
                numbered.append(key)
            return registry[key]

        path: list[list] = [[False, []]]
        before = ""
        for word in words:
            common = len(os.path.commonprefix((before, word)))
            while len(path) > common + 1:
                child = freeze(path.pop())
                path[-1][1].append((ord(before[len(path) - 1]), child))
            path.extend([False, []] for _ in word[common:])
            path[-1][0] = True
            before = word
        while len(path) > 1:
            child = freeze(path.pop())
            path[-1][1].append((ord(before[len(path) - 1]), child))
        root = freeze(path[0])
        below = np.zeros(len(numbered), np.int64)
        keys, targets, outputs = [], [], []
        for state, (final, edges) in enumerate(numbered):  # children have lower numbers
            rank = int(final)
            for label, child in edges:
                keys.append(state << 21 | label)
                targets.append(child)
                outputs.append(rank)
                rank += int(below[child])
            below[state] = rank
        order = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, np.int64)
        ids = [entries[w] for w in words]
        # the start state is told by the last element of ``final``
        final = np.array([f for f, _ in numbered] + [False], np.int32)
        final[-1] = root
        return cls(
            {
                "keys": np.array(keys, np.int64)[order],
                "targets": np.array(targets, np.int32)[order],
                "outputs": np.array(outputs, np.int32)[order],
                "final": final,
                "offsets": np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64),
                "ids": np.array([i for x in ids for i in x], np.int32),
            }
        )

    def to_bytes(self) -> bytes:
        """A file's content: a header of array sizes, then the arrays, each on an 8-byte boundary."""
        arrays = [np.ascontiguousarray(getattr(self, n)) for n in _ARRAYS]
        parts = [np.array([len(a) for a in arrays], np.int64).tobytes()]
        for a in arrays:
            parts += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
        return b"".join(parts)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        whole = np.memmap(path, np.uint8, "r")
        sizes = whole[: 8 * len(_ARRAYS)].view(np.int64)
        at, arrays = 8 * len(_ARRAYS), {}
        kinds = (np.int64, np.int32, np.int32, np.int32, np.int64, np.int32)
        for name, size, kind in zip(_ARRAYS, sizes.tolist(), kinds, strict=True):
            wide = size * np.dtype(kind).itemsize
            arrays[name] = whole[at : at + wide].view(kind)
            at += wide + -wide % 8
        return cls(arrays)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def ranks(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rank of each code-point span in the lexicon, -1 where it has none; all spans step together."""
        n = len(start)
        out = np.full(n, -1, np.int64)
        if len(self.keys) == 0 or n == 0:
            return out
        live = np.arange(n)
        state = np.full(n, int(self.final[-1]), np.int64)
        rank = np.zeros(n, np.int64)
        depth = 0
        while len(live):
            stop = start[live] + depth == end[live]
            done = live[stop]
            ok = self.final[state[done]] == 1
            out[done[ok]] = rank[done[ok]]
            live = live[~stop]
            key = (state[live] << 21) | points[start[live] + depth].astype(np.int64)
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key
            live, at = live[hit], at[hit]
            state[live] = self.targets[at]
            rank[live] += self.outputs[at]
            depth += 1
        return out

    def ids_of(self, rank: int) -> list[int]:
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].tolist()

    def ids_of_many(self, ranks: np.ndarray) -> np.ndarray:
        sizes = self.offsets[ranks + 1] - self.offsets[ranks]
        return self.ids[ranges(self.offsets[ranks], sizes)]
