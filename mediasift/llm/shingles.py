"""Word shingles of a text as sorted 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
REMEMBERED = 200_000


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The set of runs of ``words`` words (runs of letters, digits and ``_``, lower-cased).

    A text with fewer words has one shingle, all its words; one without words has none.
    """
    found = WORD.findall(text.lower()) if text else []
    if not found:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    runs = np.full(len(found) - width + 1, width, np.uint64)
    for i in range(width):
        runs = mixed(runs + hashed[i : len(found) - width + 1 + i])
    return np.unique(runs)
