"""Suffix order of a byte array by the difference cover {1, 2} modulo 3, to a bounded depth.

Sampled positions (those of residue 1 and 2) are named by their triples in
sorted order; the string of names is ordered by the same function; the rest are
ordered by their first symbol and the rank of the next sample, and merged in.
A name at level r covers 3**r symbols, so the recursion ends once a name covers
the depth that is asked for: suffixes that agree so far are then neighbours,
in any order among themselves.
"""

from __future__ import annotations

import numpy as np


def ranks(symbols: np.ndarray, depth: int, span: int = 1) -> np.ndarray:
    """The rank of each suffix of ``symbols`` (positive integers), at least by its first ``depth`` base symbols.

    ``span``: the base symbols that one symbol stands for.  Fewer than 2**21
    symbols, so that three ranks fit a 64-bit key.
    """
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64).argsort()
    # the zeros end every suffix, and give both residues a last, all-zero triple
    s = np.concatenate((symbols.astype(np.int64), np.zeros(5, np.int64)))
    base = int(symbols.max()) + 1
    one, two = np.arange(1, n + 2, 3), np.arange(2, n + 2, 3)
    sample = np.concatenate((one, two))
    _, names = np.unique((s[sample] * base + s[sample + 1]) * base + s[sample + 2], return_inverse=True)
    if names.max() + 1 < len(names) and 3 * span < depth:
        order = ranks(names + 1, depth, 3 * span)
    else:
        order = names
    r = np.zeros(n + 5, np.int64)  # rank of each sampled position, 1 and up
    r[sample] = order + 1
    m = int(order.max()) + 2

    rest = np.arange(0, n, 3)
    short = s[rest] * m + r[rest + 1]
    long = (s[rest] * base + s[rest + 1]) * m + r[rest + 2]
    by_short = np.argsort(short, kind="stable")
    one, two = one[one < n], two[two < n]
    before = np.searchsorted(np.sort(s[one] * m + r[one + 1]), short[by_short]) + np.searchsorted(np.sort((s[two] * base + s[two + 1]) * m + r[two + 2]), long[by_short])
    out = np.empty(n, np.int64)
    # ties beyond the depth may leave ``before`` uneven; keep it rising
    place = np.maximum.accumulate(before) + np.arange(len(rest))
    out[rest[by_short]] = place
    free = np.ones(n, bool)
    free[place] = False
    own = np.concatenate((one, two))
    out[own[np.argsort(r[own], kind="stable")]] = np.flatnonzero(free)
    return out


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each of ``starts`` also begin at another of them.

    Suffixes are ordered, and each start is compared with the next one in that order.
    """
    if len(starts) < 2:
        return np.zeros(len(starts), bool)
    order = np.argsort(ranks(text.astype(np.int64) + 1, length)[starts], kind="stable")
    sorted_starts = starts[order]
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded, (len(text), 8), (1, 1))
    equal = np.ones(len(starts) - 1, bool)
    offsets = sorted({*range(0, length - 7, 8), max(0, length - 8)}, key=lambda o: (o % 3, o)) if length >= 8 else []
    left = np.flatnonzero(equal)
    for o in offsets:
        a, b = words[sorted_starts[left] + o], words[sorted_starts[left + 1] + o]
        left = left[a.view(np.uint64).ravel() == b.view(np.uint64).ravel()] if len(left) else left
    for o in range(length) if length < 8 else ():
        left = left[padded[sorted_starts[left] + o] == padded[sorted_starts[left + 1] + o]]
    same = np.zeros(len(starts), bool)
    same[left] = same[left + 1] = True
    out = np.zeros(len(starts), bool)
    out[order] = same
    return out
