"""Rolling k-gram hashes and window minima over integer arrays, in numpy.

The arithmetic is modulo 2**64. A k-gram hash is a polynomial in an odd base, built by
doubling: a gram of length m + n is the gram of length m, shifted, plus the gram of length n.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that their order looks random."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def kgrams(codes: np.ndarray, k: int) -> np.ndarray:
    """The unmixed hash of each run of k values along the last axis; empty if there are fewer."""
    n = codes.shape[-1] - k + 1
    if n <= 0:
        return np.empty((*codes.shape[:-1], 0), np.uint64)
    whole, length = None, 0
    piece, width, left = codes.astype(np.uint64) + np.uint64(1), 1, k
    while left:
        if left & 1:
            if whole is None:
                whole, length = piece, width
            else:
                whole = whole[..., : piece.shape[-1] - length] * power(width) + piece[..., length:]
                length += width
        left >>= 1
        if left:
            piece = piece[..., :-width] * power(width) + piece[..., width:]
            width *= 2
    return whole[..., :n]


def window_minima(values: np.ndarray, window: int) -> np.ndarray:
    """Positions, rising, that are the rightmost minimum of some run of `window` values.

    With fewer values than a window, the one run is all of them. Work is done in blocks that
    overlap by a window, so memory beside the input is bounded whatever the length.
    """
    n = len(values)
    if not n:
        return np.empty(0, np.int64)
    window = min(window, n)
    block, found = 1 << 16, []
    for at in range(0, n - window + 1, block):
        part = values[at : at + block + window - 1]
        found.append(_minima(part, window) + at)
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def _minima(values: np.ndarray, window: int) -> np.ndarray:
    """For one block: the high 44 bits of the value order, then the place, later first."""
    place = np.uint64((1 << 20) - 1) - np.arange(len(values), dtype=np.uint64)
    least = (values & ~np.uint64((1 << 20) - 1)) | place
    width = 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        rest = window - width
        least = np.minimum(least[: len(least) - rest], least[rest:])
    at = np.int64((1 << 20) - 1) - (least & np.uint64((1 << 20) - 1)).astype(np.int64)
    keep = np.empty(len(at), bool)
    keep[0] = True
    np.not_equal(at[1:], at[:-1], out=keep[1:])
    return at[keep]
