"""Hashes over arrays of bytes, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(4)
def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64; n is a power of two."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits under which near values lie far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end]; equal bytes have equal hashes wherever they stand."""
    n = 1 << max(0, len(data) - 1).bit_length()
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers(BASE, n)[: len(data)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * powers(BASE_INVERSE, n)[starts])


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes of data."""
    one = data + np.uint64(1)
    now, length = one, 1
    for bit in bin(k)[3:]:
        now = now[: len(now) - length] * np.uint64(pow(BASE, length, 1 << 64)) + now[length:]
        length *= 2
        if bit == "1":
            now = now[: len(one) - length] * np.uint64(BASE) + one[length:]
            length += 1
    return mix(now)
