"""Vectorised 64-bit hashes of all substrings of a byte array that are asked for."""

from __future__ import annotations

import numpy as np

from shelfspark.llm.common import worker_cache

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def byte_values(seed: int = 1) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return mix(np.arange(1 + 1000 * seed, 257 + 1000 * seed, dtype=np.uint64) * np.uint64(_BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n, kept by the worker."""
    cache = worker_cache()
    held = cache.get("powers")
    if held is None or len(held[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        held = []
        for b in (_BASE, inverse):
            p = np.ones(size, dtype=np.uint64)
            filled = 1
            while filled < size:
                p[filled:2 * filled] = p[:filled] * np.uint64(pow(b, filled, 1 << 64))
                filled *= 2
            held.append(p)
        cache["powers"] = held = tuple(held)
    return held


class Substrings:
    """Hashes of substrings [lo, hi) of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray) -> None:
        up, self._down = _powers(len(values))
        self._sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[:len(values)], out=self._sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self._sums[hi] - self._sums[lo]) * self._down[lo])

    def of_length(self, n: int) -> np.ndarray:
        """Hashes of all substrings of length ``n``, in order."""
        m = len(self._sums) - n
        if m <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self._sums[n:] - self._sums[:m]) * self._down[:m])
