"""Words of whole texts as numpy arrays: boundaries, 64-bit hashes, windows of hashes."""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Separators when words are runs of letters and digits; all bytes of non-ASCII letters belong to words.
NONWORD = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32

#: Odd multipliers of the polynomial hashes, and the inverse of the first modulo 2^64.
_BYTE, _NEXT = 0x9E3779B97F4A7C15, U(0xC2B2AE3D27D4EB4F)
_BACK = pow(_BYTE, -1, 1 << 64)
_TABLES = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> list[np.ndarray]:
    """Powers of the byte multiplier and of its inverse, at least ``n`` of each."""
    if len(_TABLES[0]) < n:
        for i, base in enumerate((_BYTE, _BACK)):
            _TABLES[i] = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, U(base))]))
    return _TABLES


class Words:
    """Words of a chunk of texts. ``start``/``end``: byte places, ``row``: text, ``count``: by text,
    ``hash``: of a word's bytes as ``fold`` maps them. Words end at ``space`` and before ``breaks`` (places inside words)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE, fold: np.ndarray = SAME,
                 breaks: np.ndarray | None = None):
        n = len(data)
        inside = ~space[data]
        edge = offs[(offs > 0) & (offs < n)]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        if breaks is not None and len(breaks):
            first[breaks] = last[breaks - 1] = True
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.count = np.diff(np.searchsorted(self.start, offs))
        self.row = np.repeat(np.arange(len(offs) - 1), self.count)
        forth, back = powers(max(n + 1, 1 << 20))
        total = np.zeros(n + 1, U)
        np.cumsum((fold + U(1))[data] * forth[:n], out=total[1:])
        size = (self.end - self.start).astype(U)
        self.hash = mix((total[self.end] - total[self.start]) * back[self.start] ^ (size << U(40)))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of ``k`` words of one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        h = np.full(n, U(1))
        for j in range(k):
            h = h * _NEXT + self.hash[j:j + n]
        at = np.flatnonzero(self.row[:n] == self.row[k - 1:])
        return at, mix(h[at])

    def whole(self, rows: np.ndarray) -> np.ndarray:
        """Hash of the whole word sequence of some (short) texts."""
        h, at = np.full(len(rows), U(1)), np.cumsum(self.count)[rows] - self.count[rows]
        for j in range(int(self.count[rows].max())):
            more = self.count[rows] > j
            h[more] = h[more] * _NEXT + self.hash[at[more] + j]
        return mix(h)


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` items lie in a run of ``k`` that starts at one of the different places ``at``."""
    d = np.zeros(n + 1, np.int64)
    d[at] += 1
    np.subtract.at(d, np.minimum(at + k, n), 1)
    return np.cumsum(d[:-1]) > 0
