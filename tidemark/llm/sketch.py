"""Shingle sets and SetSketch registers of texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from .rolling import mix

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
BASE = 1.02
_LOG = np.log(BASE)
#: Registers count from the least value that 32 bits can tell apart.
_TOP = int(np.ceil(np.log(2.0**33) / _LOG)) + 1
_random = np.random.default_rng(8)
_SLOPES = _random.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_BAND_SALTS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)).reshape(BANDS, ROWS) | np.uint64(1)


class Words(dict):
    """Hashes of words, remembered; forgotten when they are many."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, memo: Words, width: int = 2) -> np.ndarray:
    """The sorted distinct hashes of runs of `width` words, A-Z lower-cased, parted by ASCII white space.

    Fewer words, but not none, are one run.
    """
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    width_here = min(width, n)
    runs = n - width_here + 1
    total = np.full(runs, np.uint64(width_here), np.uint64)
    for i in range(width_here):
        total = mix(total + own[i : i + runs])
    return np.unique(total)


def registers(sets: np.ndarray) -> np.ndarray:
    """SetSketch registers of a nonempty set: exponentially spaced, truncated minima, 16 bits each.

    The register of a union is the larger of the two registers, so sketches can be merged.
    """
    small = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
    least = np.full(REGISTERS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(small), 256):
        part = small[at : at + 256, None] * _SLOPES
        part += _SHIFTS
        # One round of mixing, as low bits of a product are poor.
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(least, part.min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1.0 - np.log(exponential) / _LOG), 0, _TOP).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, which tells the band too."""
    values = regs.astype(np.uint64).reshape(BANDS, ROWS) + np.uint64(1)
    return mix((mix(values * _BAND_SALTS)).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


_GRID = np.linspace(0.0, 1.0, 201)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of each row's two register arrays, the set sizes known.

    a, b: (pairs, REGISTERS). How often a register is larger, smaller or equal has known probabilities.
    """
    u = n_a / (n_a + n_b)
    v = 1.0 - u
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    j = _GRID[None, :] * (np.minimum(u, v) / np.maximum(u, v))[:, None]

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1.0) / BASE) / _LOG

    over, under = chance(u[:, None] - v[:, None] * j), chance(v[:, None] - u[:, None] * j)
    tiny = 1e-9
    score = more[:, None] * np.log(over + tiny) + less[:, None] * np.log(under + tiny) + same[:, None] * np.log(np.maximum(1.0 - over - under, 0.0) + tiny)
    return j[np.arange(len(j)), score.argmax(axis=1)]
