"""Word hashes and rolling hashes of word sequences, in numpy."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of byte words, with at most ``bound`` of them kept."""

    def __init__(self, bound: int = 200_000, seed: int = 0):
        self.bound, self.seed, self.known = bound, seed, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > self.bound:
            known.clear()
            new = list(set(words))
        known.update(zip(new, map(xxhash.xxh3_64_intdigest, new, repeat(self.seed)), strict=False))
        out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > self.bound:
            known.clear()
        return out


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    out = np.ones(n + 1, np.uint64)
    if n:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


class Rolling:
    """Hashes of any run of a sequence of word hashes, from prefix sums modulo 2 ** 64 with an odd base."""

    def __init__(self, hashes: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        n = len(hashes)
        self.back = powers(pow(base, -1, 1 << 64), n)  # divides out the position
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(base, n)[:n], out=self.sums[1:])

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64) * _M2)


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` entries, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x
