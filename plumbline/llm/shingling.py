"""Word shingles of texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from . import common

#: Word hashes that a Python worker remembers.
MOST_WORDS = 400_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word: A-Z lower-cased, words parted by ASCII white space."""
    found = (text or "").encode().translate(common.LOWER_TABLE).split()
    return np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))


def _fold(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words in order; of the whole sequence, if it is shorter."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = _fold(h, words[i : n - k + 1 + i])
    return h


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(shingle_hashes(word_hashes(text), k))
