"""Vectorised 64-bit hashes of words, bytes and of runs of them.

A run is hashed as a polynomial over its units modulo 2**64, from prefix sums, so the hash of
any window costs a few operations whatever its width.  Two polynomials are independent of each
other; pairs of hashes name windows.
"""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


def word_units(data: bytes) -> np.ndarray:
    """A hash per word: ``bytes.split`` parts at space and the controls 9 to 13 only."""
    return hash_words(data.split())


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def byte_units(numbers: np.ndarray) -> np.ndarray:
    """A hash per byte."""
    return _BYTES[numbers]


class Polynomial:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            grow = lambda b: np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)]))
            self.up, self.down = grow(self.base), grow(self.inverse)

    def prefix(self, units: np.ndarray) -> np.ndarray:
        self.reach(len(units) + 1)
        out = np.zeros(len(units) + 1, _U)
        np.cumsum(units * self.up[: len(units)], out=out[1:])
        return out

    def window(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.down[starts])

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """All windows of one width."""
        n = len(prefix) - width
        return mix((prefix[width:] - prefix[:n]) * self.down[:n])


FIRST = Polynomial(0x9E3779B97F4A7C15)
SECOND = Polynomial(0xC2B2AE3D27D4EB4F)
