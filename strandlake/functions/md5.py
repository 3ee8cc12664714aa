"""MD5 of all windows of a byte array at once: each step of the digest runs over thousands of windows."""

from __future__ import annotations

import math

import numpy as np

#: Windows that are hashed at once.
CHUNK = 1 << 16
#: Longest window: message and padding are one block.
MOST = 55

_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16, 32)), *((3 * i + 5) % 16 for i in range(32, 48)), *(7 * i % 16 for i in range(48, 64))]
_FIRST = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _words(data: np.ndarray, k: int, n: int) -> list[np.ndarray | int]:
    """The sixteen words of the one block of each window; those that all windows share are numbers."""
    wide = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32)
    size = len(wide) - 3
    at = wide[:size] | (wide[1 : size + 1] << np.uint32(8)) | (wide[2 : size + 2] << np.uint32(16)) | (wide[3 : size + 3] << np.uint32(24))
    whole, rest = divmod(k, 4)
    words: list[np.ndarray | int] = [at[4 * j : 4 * j + n] for j in range(whole)]
    end = 0x80 << 8 * rest
    words.append((at[4 * whole : 4 * whole + n] & np.uint32((1 << 8 * rest) - 1)) | np.uint32(end) if rest else end)
    words += [0] * (16 - len(words))
    words[14] = 8 * k
    return words


def window_md5(data: np.ndarray, k: int) -> np.ndarray:
    """The first 60 bits of the MD5 of every k-byte window, as int64."""
    if not 1 <= k <= MOST:
        raise ValueError(f"windows have 1 to {MOST} bytes")
    total = max(len(data) - k + 1, 0)
    out = np.empty(total, np.int64)
    for begin in range(0, total, CHUNK):
        n = min(CHUNK, total - begin)
        words = _words(data[begin : begin + n + k - 1], k, n)
        a, b, c, d = (np.full(n, x, np.uint32) for x in _FIRST)
        f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, f)
                np.bitwise_and(f, b, f)
                np.bitwise_xor(f, d, f)
            elif i < 32:
                np.bitwise_xor(b, c, f)
                np.bitwise_and(f, d, f)
                np.bitwise_xor(f, c, f)
            elif i < 48:
                np.bitwise_xor(b, c, f)
                np.bitwise_xor(f, d, f)
            else:
                np.invert(d, f)
                np.bitwise_or(f, b, f)
                np.bitwise_xor(f, c, f)
            word, add = words[_WORDS[i]], _SINES[i]
            if isinstance(word, int):
                add = (add + word) & 0xFFFFFFFF
            else:
                np.add(f, word, f)
            np.add(f, np.uint32(add), f)
            np.add(f, a, f)
            np.left_shift(f, np.uint32(_TURNS[i]), t)
            np.right_shift(f, np.uint32(32 - _TURNS[i]), f)
            np.bitwise_or(f, t, f)
            np.add(f, b, a)
            a, b, c, d = d, a, b, c
        high, low = ((x + np.uint32(first)).byteswap().astype(np.uint64) for x, first in ((a, _FIRST[0]), (b, _FIRST[1])))
        out[begin : begin + n] = (((high << np.uint64(32)) | low) >> np.uint64(4)).view(np.int64)
    return out
