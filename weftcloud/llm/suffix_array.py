"""Sorts the suffixes of an integer sequence by packing ranks: each round multiplies the sorted depth."""

from __future__ import annotations

import numpy as np


def sort_suffixes(seq: np.ndarray, top: int, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(order, levels): suffixes ordered by `depth` symbols at least, ties by position; levels: (symbols, rank of each suffix).

    seq: integers from 0 (separator, also past the end) to top - 1.
    """
    n = len(seq)
    rank, have, levels, order = seq.astype(np.int64), 1, [(1, seq)], np.arange(n)
    while have < depth or len(levels) == 1:
        bits = max(int(top).bit_length(), 1)
        per = min(max(63 // bits, 2), max(-(-depth // have), 2))
        key = np.zeros(n, np.uint64)
        for k in range(per):
            if k * have < n:
                key[: n - k * have] |= rank[k * have :].astype(np.uint64) << np.uint64(bits * (per - 1 - k))
        order = np.argsort(key, kind="stable")
        ranked = np.cumsum(np.concatenate([np.ones(min(1, n), np.int64), np.diff(key[order]).astype(bool)]))
        rank = np.empty(n, np.int64)
        rank[order] = ranked
        have, top = have * per, int(ranked[-1]) + 1 if n else 1
        levels.append((have, rank))
        if top > n:  # no two suffixes are alike any more
            break
    return order, levels


def common_prefixes(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a[i] and b[i], up to the sorted depth."""
    n = len(levels[0][1])
    out = np.zeros(len(a), np.int64)
    above = levels[-1][0] * 2
    for size, rank in reversed(levels):
        for _ in range(max(above // size - 1, 1)):
            x, y = a + out, b + out
            inside = (x < n) & (y < n)
            same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
            if not same.any():
                break
            out[same] += size
        above = size
    return out
