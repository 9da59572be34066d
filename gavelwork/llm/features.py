"""Hashed word and character n-grams of distinct words, many words at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_EDGE = 1  # code point that stands before and after a word
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * _M2
        return x ^ (x >> np.uint64(32))


def code_points(distinct: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between two edge marks, and where each word begins."""
    joined = chr(_EDGE) + (chr(_EDGE) * 2).join(distinct) + chr(_EDGE) if distinct else ""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 2
    return points, np.cumsum(sizes) - sizes


def word_hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word, from its code points and their places."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff([*starts, len(points)])
    place = (np.arange(len(points)) - np.repeat(starts, sizes)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return _mixed(np.add.reduceat(_mixed((points + np.uint64(7)) * _M1 + place * _M2), starts))


def ngrams(distinct: Sequence[str], sizes: Sequence[int], buckets: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of all words and the word of each feature, in no order.

    Features are the character n-grams of the word between its edges and, if asked for, the
    word itself. A word shorter than an n-gram has none of that size.
    """
    points, starts = code_points(distinct)
    owner = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff([*starts, len(points)]))
    found, owners = [], []
    if whole:
        found.append((word_hashes(points, starts) % np.uint64(buckets)).astype(np.int32))
        owners.append(np.arange(len(starts), dtype=np.int32))
    for n in sizes:
        if len(points) < n:
            continue
        inside = np.flatnonzero(owner[:len(points) - n + 1] == owner[n - 1:]).astype(np.int32)
        key = np.full(len(inside), n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                key *= _M1
                key += points[inside + k]
        found.append((_mixed(key) % np.uint64(buckets)).astype(np.int32))
        owners.append(owner[inside])
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(found), np.concatenate(owners)
