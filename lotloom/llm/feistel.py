"""Feistel permutation of 0..n-1 with cycle walking, vectorised over numpy arrays.

A balanced Feistel network permutes 0..4**h-1, where 4**h is the least power of four that is n or more.
A value that lands at n or above is permuted again until it lands below n; as the network is a permutation,
this walk always returns to 0..n-1 and the walked map is a permutation of 0..n-1 itself. The round function
uses products below 2**62 only, so that SQL's 64-bit integers can repeat it.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 6
LOW = (1 << 31) - 1
M1, M2, M3 = 1103515245, 1812433253 & LOW, 69069


def half_bits(n: int) -> int:
    """Bits of each half."""
    h = 1
    while 4**h < n:
        h += 1
    return h


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """A 31-bit key for each round."""
    keys, x = [], (seed * 2654435761 + 12345) & LOW
    for _ in range(rounds):
        x = (x * M1 + 12345) & LOW
        x ^= x >> 15
        keys.append(x)
    return keys


def _mix(x: np.ndarray, key: int, h: int) -> np.ndarray:
    x = ((x ^ np.int64(key)) * np.int64(M1) + np.int64(key)) & np.int64(LOW)
    x ^= x >> np.int64(15)
    x = (x * np.int64(M2)) & np.int64(LOW)
    x ^= x >> np.int64(13)
    x = (x * np.int64(M3)) & np.int64(LOW)
    x ^= x >> np.int64(16)
    return x & np.int64((1 << h) - 1)


class Permutation:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, seed: int):
        if n > 1 << 62:
            raise ValueError("n is above 2**62")
        self.n, self.h, self.keys = n, half_bits(n), round_keys(seed)

    def _once(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        h, low = np.int64(self.h), np.int64((1 << self.h) - 1)
        left, right = x >> h, x & low
        for k in keys:
            if back:
                left, right = right ^ _mix(left, k, self.h), left
            else:
                left, right = right, left ^ _mix(right, k, self.h)
        return (left << h) | right

    def _walk(self, x, keys: list[int], back: bool) -> np.ndarray:
        x = np.array(x, dtype=np.int64)
        if x.size and (x.min() < 0 or x.max() >= self.n):
            raise ValueError("a value is outside 0..n-1")
        out = self._once(x, keys, back)
        while (far := np.flatnonzero(out >= self.n)).size:
            out[far] = self._once(out[far], keys, back)
        return out

    def forward(self, x) -> np.ndarray:
        return self._walk(x, self.keys, False)

    def inverse(self, y) -> np.ndarray:
        return self._walk(y, self.keys[::-1], True)
