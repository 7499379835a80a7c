"""Hashes of words and word runs of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
#: ASCII white space as U+0020, A-Z in lower case, all other bytes as they are.
SPACE_WORDS = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._row(b, n) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        row = np.full(n, base & MASK, np.uint64)
        row[0] = 1
        return np.multiply.accumulate(row)


def hash_words(texts: Sequence[bytes | None], table: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the bounds of each text's words: text i has words bounds[i] to bounds[i + 1].

    Words are what ``table`` does not map to a space. The hash of a word is a sum over its
    bytes, weighted by their place, which differences of running sums give for all words.
    """
    joined = b" ".join(t or b"" for t in texts).translate(table)
    codes = np.frombuffer(joined, np.uint8)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes != 32).view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers.upto(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[codes] * up[: len(codes)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    places = np.cumsum([len(t or b"") + 1 for t in texts])
    return hashes, np.concatenate(([0], np.searchsorted(starts, places)))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each place on; as many as fit."""
    count = len(words) - length + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    run = words[:count].copy()
    for k in range(1, length):
        run = run * np.uint64(BASE) + words[k : k + count]
        run ^= run >> np.uint64(29)
    return mixed(run)
