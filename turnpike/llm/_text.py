"""Word-level helpers shared by the operators. A word is a run of bytes other than 0x20 and 0x09-0x0D.

``bytes.split()`` splits at just these six bytes, so texts are handled as UTF-8 bytes throughout.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Word hashes that one worker remembers; it bounds memory and changes no result.
WORD_MEMORY = 400_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Eight bytes of XXH64 for each word, remembered while there is room."""

    def __missing__(self, word: bytes) -> bytes:
        found = xxhash.xxh64_digest(word, 7)
        if len(word) <= 64:
            if len(self) >= WORD_MEMORY:
                self.clear()
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype="<u8")


def rolling_hash(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` word hashes; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    base = np.uint64(xxhash.xxh64_intdigest(b"rolling base", seed) | 1)
    total, power = np.zeros(n, dtype=np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            power = power * base
            total += words[j : j + n] * power
        total ^= total >> np.uint64(32)
        total *= _GOLDEN
        total ^= total >> np.uint64(29)
    return total
