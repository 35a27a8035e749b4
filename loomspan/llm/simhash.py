"""Shingles and SimHash fingerprints, vectorized over Arrow batches."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import numpy as np

SHINGLE = 5
WORD = re.compile(r"\w+")
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class Hasher:
    """Word hashes with a cache; a pure function of the word on every machine.

    ``mask``: words with digits (numbers, dates, reference ids) are all one word.
    """

    def __init__(self, mask: bool = False) -> None:
        self.seen: dict[str, int] = {}
        self.mask = mask

    def words(self, tokens: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
        out = []
        for t in tokens:
            h = seen.get(t)
            if h is None:
                w = "0" if self.mask and not t.isalpha() and any(c.isdigit() for c in t) else t
                h = seen[t] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
            out.append(h)
        return np.array(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all k-word shingles; a shorter text is one shingle."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(31) + words[i : i + n] * _MULT[i]
    return mix(h)


def fingerprint(features: np.ndarray) -> int:
    """64-bit SimHash of hashed features, as a signed long."""
    bits = np.unpackbits(features.view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(np.add.reduce(bits, axis=0, dtype=np.uint32) * 2 > len(features)).view(np.int64)[0])


def table_masks(blocks: int, equal: int) -> list[int]:
    """Bit masks of the partitioned tables: every choice of ``equal`` of the ``blocks``.

    Fingerprints within blocks - equal bits of each other always agree on a
    mask (pigeonhole); others do where their differences fall together.
    """
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    part = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    out = []
    for c in combinations(part, equal):
        m = sum(c)
        out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out
