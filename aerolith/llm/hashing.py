"""64-bit hashes of words and of runs of words or bytes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
#: Odd multipliers.
STEP = U64(0x9E3779B97F4A7C15)
BASE = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)


class WordHashes(dict):
    """Hash of a word (bytes); forgets what it knows when it has grown too large."""

    most = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    p = np.full(n + 1, base, U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
