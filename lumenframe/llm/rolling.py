"""Polynomial hashes of runs of values, modulo 2^64.

They find places to look at, quickly and for whole arrays at once. Two different
runs can have one hash (for long runs of two values that is easy to bring about),
so nothing is decided by them alone.
"""

from __future__ import annotations

import numpy as np


def rolled(values: np.ndarray, window: int, base: int) -> np.ndarray:
    """The hash of every ``window`` values: the sum of base^k times the k-th.

    By doubling: the hash of 2m values is that of the first m plus base^m times that
    of the next m."""
    n = len(values) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, m = None, 0, values, 1
    while True:
        if window & m:
            if out is None:
                out = power
            else:
                size = len(values) - done - m + 1
                out = out[:size] + power[done : done + size] * np.uint64(pow(base, done, 1 << 64))
            done += m
        if 2 * m > window:
            return out[:n]
        size = len(values) - 2 * m + 1
        power = power[:size] + power[m : m + size] * np.uint64(pow(base, m, 1 << 64))
        m *= 2


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
