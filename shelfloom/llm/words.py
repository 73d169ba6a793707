"""Words, hashes and shingles of a text, for the operators that run in Python workers."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"\w+")
#: Fixed odd multipliers, one for each place in a shingle.
_PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=np.uint64,
)


#: Characters or bytes of a word up to which a worker keeps what it knows of it.
KEPT_LENGTH = 64


class WordHashes(dict):
    """64-bit hash of a word, kept for the words seen lately: at most ``limit`` of at most ``KEPT_LENGTH`` characters."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def blank_separated(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def plain_words(text: str | None) -> list[str]:
    """Runs of word characters in lower case; none for null."""
    return _WORD.findall(text.lower()) if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, in order; with fewer words, of all of them as one."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total += mix(hashes[i : n - size + 1 + i] + np.uint64(i)) * _PLACES[i % 8]
    return mix(total)
