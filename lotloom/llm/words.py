"""Word hashes of many texts at once, in numpy.

Words are maximal runs outside [\\x20\\x09-\\x0D] of the UTF-8 text. A word's hash is a polynomial over random byte
values mod 2**64, taken from differences of one running sum, then mixed.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER_VALUES = VALUES.copy()
LOWER_VALUES[65:91] = VALUES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for i, p in enumerate((_P, _P_INV)):
                t = np.full(size, p, np.uint64)
                t[0] = 1
                _powers[i] = np.multiply.accumulate(t)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hashes, text number, and begin and end in the joined bytes of every word; and the joined bytes."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    up, down = _power_tables(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(buf) + 1, np.uint64)
        total[0] = 0
        np.cumsum((LOWER_VALUES if lower else VALUES)[buf] * up[: len(buf)], out=total[1:])
        hashes = mix((total[end] - total[begin]) * down[begin])
    bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return hashes, np.searchsorted(bounds, begin, side="right"), begin, end, buf


def blocks(texts: list[str | None], limit: int = 1_000_000) -> list[tuple[int, list[bytes]]]:
    """The texts as bytes in runs of about `limit` bytes, each with the number of its first text; null is empty."""
    out, run, first, size = [], [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        run.append(b)
        size += len(b)
        if size >= limit:
            out.append((first, run))
            run, first, size = [], i + 1, 0
    if run:
        out.append((first, run))
    return out
