"""Word shingles and one-permutation MinHash signatures of whole texts.

Words are maximal runs of characters other than the space and U+0009..U+000D; only A-Z is lower-cased.
A document's set holds its distinct runs of ``width`` consecutive words, each as a 64-bit hash; with fewer words
the whole sequence is the one member, and without any word the set is empty.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word, computed once; emptied when it holds ``limit`` words, so memory stays bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of the whole text (null: empty)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    n = len(words) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):  # order matters: each word is mixed into what precedes it
        acc = mix(acc * _STEP + h[j : j + n])
    return np.unique(acc)


class OnePermutation:
    """One-permutation MinHash: a shingle's hash picks one bin and a value; each bin keeps its least value.

    Empty bins are filled by optimal densification: bin i probes bins drawn by a fixed hash of (i, attempt) until
    one that was filled from the set itself, and copies it. The draws depend on i and the attempt only, so equal
    bins stay equal and each copied bin is an unbiased min-hash.
    """

    def __init__(self, bands: int = 32, rows: int = 6, seed: int = 11):
        self.bands, self.rows = bands, rows
        self.bins = bands * rows
        self.seed = np.uint64(seed)
        self._probe: list[np.ndarray] = []

    def _draw(self, t: int) -> np.ndarray:
        """For each bin the bin that its attempt ``t`` probes."""
        while t >= len(self._probe):
            i = np.arange(self.bins, dtype=np.uint64)
            salt = mix(np.full(self.bins, len(self._probe) + 1, np.uint64))
            self._probe.append((mix(i * _STEP + salt) % np.uint64(self.bins)).astype(np.int64))
        return self._probe[t]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """``bins`` 64-bit values of a non-empty set."""
        h = mix(shingles ^ self.seed)
        where = (h % np.uint64(self.bins)).astype(np.int64)
        sig = np.full(self.bins, np.iinfo(np.uint64).max, np.uint64)
        order = np.argsort(h, kind="stable")[::-1]
        sig[where[order]] = h[order]  # the last write to a bin is its least value
        filled = np.zeros(self.bins, bool)
        filled[where] = True
        empty = np.flatnonzero(~filled)
        t = 0
        while empty.size:
            source = self._draw(t)[empty]
            ok = filled[source]
            sig[empty[ok]] = sig[source[ok]]
            empty = empty[~ok]
            t += 1
        return sig

    def band_keys(self, sig: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key per band; the band's number is part of the key."""
        parts = sig.reshape(self.bands, self.rows)
        acc = np.arange(1, self.bands + 1, dtype=np.uint64) * _STEP
        for j in range(self.rows):
            acc = mix(acc * _STEP + parts[:, j])
        return acc.view(np.int64)
