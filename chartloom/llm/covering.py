"""A covering code of 64-bit words: two perfect binary Golay blocks and a free tail.

Bits 0-22 and 23-45 are blocks of the [23,12] Golay code, whose covering radius
is 3, and each word has exactly one code word within it.  The tail's code has a
single word (its covering radius is its length), so an anchor is 46 bits wide
and there are 2**24 of them.  Let x lie within the radius of its own anchor in
each block; a word y at distance d from x lies within 3 + d1 and 3 + d2 of that
anchor with d1 + d2 <= d.  So y, sent to all anchors of that kind, meets x at
x's own anchor.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
N, PARITY = 23, 11
MASK = (1 << N) - 1


def _remainder(word: int) -> int:
    for i in range(N - 1, PARITY - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - PARITY)
    return word


@lru_cache(1)
def _tables():
    """Syndromes by byte; the error of each syndrome; each syndrome's code words by extra distance."""
    unit = [_remainder(1 << i) for i in range(N)]
    parts = np.zeros((3, 256), np.int64)
    for part in range(3):
        for byte in range(256):
            s = 0
            for i in range(8):
                if byte >> i & 1 and part * 8 + i < N:
                    s ^= unit[part * 8 + i]
            parts[part, byte] = s
    flips = [()] + [c for k in (1, 2, 3) for c in combinations(range(N), k)]
    words = np.array([sum(1 << i for i in c) for c in flips], np.int64)
    error = np.zeros(1 << PARITY, np.int64)
    error[syndrome(words, parts)] = words
    return parts, error


def syndrome(words: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return parts[0][words & 255] ^ parts[1][words >> 8 & 255] ^ parts[2][words >> 16]


@lru_cache(4)
def _near(extra: int):
    """For each syndrome: the code words within 3 + extra, less the own one, and how much over 3 each is."""
    parts, error = _tables()
    cases = np.arange(1 << PARITY, dtype=np.int64)
    found: dict[tuple[int, int], int] = {}
    for k in range(extra + 1):
        for c in combinations(range(N), k):
            flip = sum(1 << i for i in c)
            own = error[cases]  # a word of that syndrome whose own code word is 0
            moved = own ^ flip
            offset = moved ^ error[syndrome(moved, parts)]
            for s, o in zip(cases.tolist(), offset.tolist(), strict=True):
                found.setdefault((s, o), k)
    keys = sorted(found)
    start = np.searchsorted([s for s, _ in keys], np.arange((1 << PARITY) + 1))
    return start, np.array([o for _, o in keys], np.int64), np.array([found[k] for k in keys], np.int64)


def _block(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The own code word and the syndrome of each 23-bit word."""
    parts, error = _tables()
    s = syndrome(words, parts)
    return words ^ error[s], s


def anchor(fingerprints: np.ndarray) -> np.ndarray:
    """The own anchor of each uint64 fingerprint."""
    low, _ = _block((fingerprints & np.uint64(MASK)).astype(np.int64))
    high, _ = _block((fingerprints >> np.uint64(N) & np.uint64(MASK)).astype(np.int64))
    return low | high << N


def anchors_within(fingerprints: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all anchors within the covering radius plus ``extra``, the own one included."""
    start, offsets, over = _near(extra)
    rows = np.arange(len(fingerprints))
    out = np.zeros(len(fingerprints), np.int64)
    used = np.zeros(len(fingerprints), np.int64)
    for shift in (0, N):
        own, s = _block((fingerprints[rows] >> np.uint64(shift) & np.uint64(MASK)).astype(np.int64))
        n = start[s + 1] - start[s]
        at = np.repeat(start[s] - np.cumsum(n) + n, n) + np.arange(n.sum())
        keep = np.repeat(used, n) + over[at] <= extra
        grown = np.repeat(out, n) | (np.repeat(own, n) ^ offsets[at]) << shift
        rows, out, used = np.repeat(rows, n)[keep], grown[keep], (np.repeat(used, n) + over[at])[keep]
    return rows, out
