"""Hashed character n-grams and words of many texts at once, in numpy.

Texts are lower-cased, runs of white space become one space, and a space is put
at both ends.  A polynomial running hash over the code points gives the hash of
any slice as a difference, so all n-grams of a chunk of texts are hashed by a
few array operations.  Sums wrap modulo 2**64; the multiplier is odd and so has
an inverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: Characters in one chunk: bounds the memory of a batch (a longer text is a chunk of its own, see ``chunks``).
CHUNK = 1 << 18
SPACE = 32


def normal(text: str | None) -> str:
    return f" {' '.join((text or '').lower().split())} "


def chunks(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, code points, start of each text) for runs of texts of about CHUNK characters."""
    first, parts, size = 0, [], 0
    for i, text in enumerate(texts):
        parts.append(normal(text))
        size += len(parts[-1])
        if size >= CHUNK or i == len(texts) - 1:
            points = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
            yield first, points, np.cumsum([0, *map(len, parts[:-1])])
            first, parts, size = i + 1, [], 0


class Hasher:
    """The running hash of a chunk, and bucket numbers of its slices."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.powers = _powers(MULTIPLIER, n + 1)
        self.inverses = _powers(INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=self.sums[1:])
        self.points = points

    def slices(self, start: np.ndarray, end: np.ndarray, salt: int, buckets: int) -> np.ndarray:
        """The bucket of each slice; buckets is a power of two."""
        h = (self.sums[end] - self.sums[start]) * self.inverses[start]
        h ^= np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)

    def slices64(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The whole hash of each slice."""
        h = (self.sums[end] - self.sums[start]) * self.inverses[start]
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)

    def grams(self, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, bucket) of the n-grams that have a space at their ends at most."""
        space = self.points == SPACE
        inside = np.concatenate(([0], np.cumsum(space)))
        count = len(self.points) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.flatnonzero(inside[n - 1 : n - 1 + count] == inside[1 : 1 + count])  # positions 1..n-2 of the window
        return start, self.slices(start, start + n, n, buckets)

    def words(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, bucket) of the words."""
        space = self.points == SPACE
        start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        return start, end, self.slices(start, end, 1, buckets)


_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _known or len(_known[base]) < n:
        grown = np.full(max(n, CHUNK * 2), np.uint64(base), np.uint64)
        grown[0] = 1
        _known[base] = np.multiply.accumulate(grown)
    return _known[base][:n]
