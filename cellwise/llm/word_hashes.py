"""Words of many texts at once: places and 64-bit hashes by numpy passes over the joined bytes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: White space of the words [^\x20\x09-\x0D]+.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x5851F42D4C957F2B
#: A random 64-bit value for each byte value, so that a word's hash is a polynomial in random coefficients.
_VALUES = np.random.default_rng(20).integers(1, 1 << 64, 256, np.uint64)
_VALUES[WHITE] = 0
_STEP = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


@lru_cache(4)
def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n modulo 2 ** 64."""
    return np.r_[np.uint64(1), np.cumprod(np.full(n, base & ((1 << 64) - 1), np.uint64))]


def up_and_down(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, n of each at least."""
    size = 1 << max(16, int(n).bit_length())
    return powers(base, size), powers(pow(base, -1, 1 << 64), size)


def word_hashes(texts: list[bytes], cut: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in order: hash, first byte, byte behind the last, and (for texts, one more than there are) the first
    word of each text; and the joined bytes, in which each text is followed by one space.

    `cut` gives the bytes to read in their place (as many, white space alike) and marks those inside words with which a new word begins.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty.view(np.uint64), empty, empty, np.zeros(len(texts) + 1, np.int64), data
    white = WHITE[data]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edges = np.r_[0, edges]
    first, end = edges[::2], edges[1::2]
    if cut:
        data, inner = cut(data)
        inner = np.flatnonzero(inner)
        first, end = (np.sort(np.r_[x, inner], kind="stable") for x in (first, end))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    of_text = np.searchsorted(first, np.r_[0, ends])
    # Differences of prefix sums, moved to the origin; a block at a time, so that tables of powers stay small.
    h = np.zeros(len(first), np.uint64)
    up, down = up_and_down(_BASE, min(len(data), _STEP))
    for a in range(0, len(data), _STEP):
        b = min(a + _STEP, len(data))
        sums = np.r_[np.uint64(0), np.cumsum(_VALUES[data[a:b]] * up[: b - a])]
        i, j = np.searchsorted(end, a, side="right"), np.searchsorted(first, b)
        s, e = np.maximum(first[i:j], a) - a, np.minimum(end[i:j], b) - a
        part = (sums[e] - sums[s]) * down[s]
        if i < j and first[i] < a:  # a word that began in an earlier block goes on with the powers that follow there
            part[:1] *= np.uint64(pow(_BASE, int(a - first[i]), 1 << 64))
        h[i:j] += part
    return mixed(h), first, end, of_text, data
