"""Hashed word shingles of whole texts, and their MinHash signatures, as numpy passes over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from stratakv.llm.common import byte_slices

WORDS = 5
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3: every bit of the input changes every bit of the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least ``n`` of each."""
    return _powers(max(19, int(n).bit_length()))


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash of each word, first word of each text and the end)``: runs of bytes that are not white space, A-Z lowered."""
    n = len(data)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    at_text = offs[:-1][offs[:-1] < n]
    begins[at_text] = solid[at_text]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = offs[1:][offs[1:] > 0] - 1
    ends[last] = solid[last]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[:n], out=total[1:])
    h = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h, np.searchsorted(start, offs)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, data, offs in byte_slices(column):
        h, first = words_of(data, offs)
        grams = np.zeros(0, np.uint64)
        if len(h) >= WORDS:
            grams = mix(sum((h[k : len(h) - WORDS + 1 + k] * _PLACE[k] for k in range(WORDS)), np.uint64(0)))
        f = first.tolist()
        for a, b in zip(f, f[1:], strict=False):
            if b - a >= WORDS:
                yield np.unique(grams[a : b - WORDS + 1])
            elif b > a:  # fewer words: the whole sequence as one
                yield mix((h[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


@cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(n)
    return r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None], (r.integers(0, 1 << 31, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)[:, None]


def signature(grams: np.ndarray, size: int) -> np.ndarray:
    """Least value of each of ``size`` hash functions over a set of shingles."""
    salt, factor = _functions(size)
    x = (grams >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for k in range(0, x.shape[1], 1024):
        v = (x[:, k : k + 1024] ^ salt) * factor
        v ^= v >> np.uint32(15)
        np.minimum(out, (v * np.uint32(0x2C1B3C6D)).min(1), out=out)
    return out
