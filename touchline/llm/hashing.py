"""64-bit hashes of byte ranges, worked out for many ranges at once."""

from __future__ import annotations

import functools

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)


@functools.lru_cache(8)
def byte_values(seed: int, fold_case: bool = False) -> np.ndarray:
    """A random number per byte; with ``fold_case`` A-Z count as a-z."""
    table = np.random.default_rng(seed).integers(0, 2**64, 256, np.uint64)
    if fold_case:
        table[65:91] = table[97:123]
    return table


@functools.lru_cache(4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(size, _MULTIPLIER, np.uint64)
    inverse = np.full(size, np.uint64(pow(int(_MULTIPLIER), -1, 2**64)), np.uint64)
    base[:1] = inverse[:1] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64, at least ``n`` of them."""
    return _powers(1 << max(12, int(n).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHasher:
    """Hashes of ``raw[a:b]`` from running sums; equal bytes give equal hashes wherever they stand."""

    def __init__(self, raw: np.ndarray, seed: int = 1, fold_case: bool = False):
        self.up, self.down = powers(len(raw) + 1)
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        values = byte_values(seed, fold_case).take(raw)
        values *= self.up[: len(raw)]
        np.cumsum(values, out=sums[1:])
        self.sums = sums

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + length)
