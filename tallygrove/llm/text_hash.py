"""Vectorised hashing of words, n-grams and word shingles of one text.

Used inside tasks only. Hashes depend on nothing but the bytes, so every
executor and every rerun gives the same values.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BLOCK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply) of each element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(salt))


def _powers(base: int) -> np.ndarray:
    out = np.ones(_BLOCK, dtype=U)
    with np.errstate(over="ignore"):
        out[1:] = np.multiply.accumulate(np.full(_BLOCK - 1, base, dtype=U))
    return out


_BYTE = seeds(256, 11)
_POW, _POW_HIGH = _powers(0xD6E8FEB86659FD93), _powers(0xA0761D6478BD642F)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def to_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word (maximal run of bytes that are not ASCII white space)."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge = np.diff(np.concatenate(([0], (~_SPACE[data]).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def run_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One hash per run of values; runs begin at `starts` and cover all values."""
    length = np.diff(starts, append=len(values))
    at = np.arange(len(values)) - np.repeat(starts, length)
    with np.errstate(over="ignore"):
        scaled = values * _POW[at & (_BLOCK - 1)]
        if length.max() > _BLOCK:
            scaled *= _POW_HIGH[(at >> 16) & (_BLOCK - 1)]
        return mix(np.add.reduceat(scaled, starts) + length.astype(U) * U(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """One hash per word."""
    first, end = word_bounds(data)
    if not len(first):
        return np.zeros(0, dtype=U)
    length = end - first
    return run_hashes(_BYTE[data[~_SPACE[data]]], np.cumsum(length) - length)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of `width` elements."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, dtype=U)
    out = np.zeros(n, dtype=U)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * U(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(out)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles of `width` lower-cased words; a shorter text is one shingle."""
    words = word_hashes(ascii_lower(to_bytes(text)))
    if 0 < len(words) < width:
        return mix(windows(words, len(words)) + U(len(words)))
    return np.unique(windows(words, width))
