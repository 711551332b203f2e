"""Words and hashed word shingles of texts, vectorised per document; shared by the operators on words."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _A
    x = x ^ (x >> np.uint64(27))
    x = x * _B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; starts anew beyond `limit` words."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, text: str | None, lower: bool = True) -> np.ndarray:
        """Hashes of the words [^\\x20\\x09-\\x0D]+ in order, A-Z lower-cased if asked."""
        if not text:
            return np.empty(0, np.uint64)
        if len(self) > self.limit:
            self.clear()
        raw = text.encode("utf-8", "replace")
        words = (raw.translate(_LOWER) if lower else raw).split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_WORD = bytes(c not in b" \t\n\v\f\r" for c in range(256))
_VALUE = mix(np.frombuffer(_LOWER, np.uint8).astype(np.uint64) + _G)
_VALUE[~np.frombuffer(_WORD, np.bool_)] = 0


class WordSums:
    """64-bit hashes of lower-cased words by array arithmetic over a text's bytes, with no object for a word.

    A byte's value times a power of an odd number for its place is summed over a word; the power of the word's start is then divided out. Work goes by blocks
    of about BLOCK bytes that end between words, so the tables of powers grow with the longest word only.
    """

    BLOCK, BASE = 1 << 16, 0x9E6C63D0876A9A35

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, min(2 * n, self.BLOCK))
            power = lambda x: np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)].cumprod(dtype=np.uint64)
            self.up, self.down = power(self.BASE), power(pow(self.BASE, -1, 1 << 64))

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words [^\\x20\\x09-\\x0D]+ in order, A-Z lower-cased."""
        data = (" " + (text or "")).encode("utf-8", "replace")
        raw, word = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(_WORD), np.bool_)
        starts = np.flatnonzero(word[1:] > word[:-1]) + 1
        out, k = np.empty(len(starts), np.uint64), 0
        while k < len(starts):
            lo = int(starts[k])
            end = int(np.searchsorted(starts, lo + self.BLOCK))
            hi = int(starts[end]) if end < len(starts) else len(raw)
            self._reach(hi - lo)
            first = starts[k:end] - lo
            out[k:end] = np.add.reduceat(_VALUE.take(raw[lo:hi]) * self.up[: hi - lo], first) * self.down[first]
            k = end
        return mix(out)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words; of the whole sequence if it is shorter, of nothing if it is empty."""
    n = min(size, len(words))
    if not n:
        return words
    out = mix(words[: len(words) - n + 1] + _G)
    for i in range(1, n):
        out = mix(out * _G + words[i : len(words) - n + 1 + i])
    return out
