"""Word shingle hashes of whole texts, computed in bulk."""

from __future__ import annotations

import numpy as np
import xxhash

# odd multipliers: a shingle's hash is a mix of the sum of its words' hashes,
# each times the multiplier of its place
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                   0xA0761D6478BD642F], np.uint64)


def words_of(text: str) -> list[bytes]:
    """Words (runs without ASCII white space) with A-Z lower-cased."""
    return text.encode("utf-8").lower().split()


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; with fewer
    words than ``size`` the whole sequence is one shingle, without words none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        if len(w) < size:
            h = (w * PLACES[:len(w)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w))
        else:
            n = len(w) - size + 1
            h = np.zeros(n, np.uint64)
            for i in range(size):
                h += w[i:i + n] * PLACES[i]
    return np.unique(mix(h))
