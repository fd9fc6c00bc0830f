"""Hashes of all substrings of a byte buffer from prefix sums, in uint64 arithmetic."""

from __future__ import annotations

import numpy as np

from .common import mix64, stream64

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SYMBOLS = stream64(20_240_229, 256)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1); kept and lengthened when a longer buffer comes."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        size = max(n, 1 << 20)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        _powers[int(base)] = known
    return known[:n]


class PrefixHash:
    """``of(starts, ends)`` is a 64-bit hash of each buffer[start:end] that depends on those symbols alone: bytes, or
    uint64 values that are hashes themselves."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data if data.dtype == np.uint64 else SYMBOLS[data]) * powers(BASE, len(data)), out=self.sums[1:])
        self.back = powers(INVERSE, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def windows(self, size: int) -> np.ndarray:
        """The hash at every start of a window of ``size`` bytes."""
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """min(keys[i : i + width]) for every whole window, in time that doesn't depend on the width."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, keys.dtype)
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(keys.dtype).max, keys.dtype)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
