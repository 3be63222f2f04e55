"""Hashes of words and word shingles, as numpy arrays."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text: lower case, split at white space."""
    words = (text or "").lower().split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in lower case.

    A text with fewer words has one shingle, of all; one without words none.
    """
    h = word_hashes(text)
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return mix(out)


def weighted_shingles(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their weights ``1 + ln(count)``."""
    ids, counts = np.unique(shingles(text, size), return_counts=True)
    return ids, 1 + np.log(counts)
