"""Classes of equal substrings of one length, from a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def _small(n: int) -> type:
    """The narrowest kind of integers for positions up to n."""
    return np.int32 if n < 1 << 31 else np.int64


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): positions by key, equal ones by position; rank from 1, equal for equal keys."""
    kind = _small(len(keys) + 1)
    order = np.argsort(keys, kind="stable").astype(kind)
    s = keys[order]
    rank = np.empty(len(keys), kind)
    rank[order] = np.cumsum(np.concatenate([[True], s[1:] != s[:-1]]), dtype=kind)
    return order, rank


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes by their first `depth` symbols (0..256) at least, then by position: prefix doubling from 7 symbols."""
    n = len(symbols)
    key, padded = np.zeros(n, np.uint64), np.concatenate([symbols, np.zeros(7, symbols.dtype)])
    for i in range(7):
        key <<= np.uint64(9)
        key |= padded[i : i + n].astype(np.uint64)
    order, rank = _ranks(key)
    have = 7
    while have < depth and rank[order[-1]] < n:
        key = rank.astype(np.int64) * (n + 1)
        key[: max(0, n - have)] += rank[have:]
        order, rank = _ranks(key)
        have *= 2
    return order


def window_classes(symbols: np.ndarray, length: int) -> np.ndarray:
    """A class for each position: positions whose next `length` symbols are equal and hold no separator have the same class.
    symbols: 1..256, with 0 after every string.

    Boundaries between neighbouring suffixes get their common prefix, where it is shorter than `length`, by increasing value:
    the interval of a string w (its suffixes) is extended backward by every symbol c that precedes it, which gives the interval
    of cw; if the boundary at its end is still open, its common prefix is |w|, and cw joins the next breadth. Every boundary
    closes once; those still open after `length` rounds have `length` or more.
    """
    n = len(symbols)
    kind = _small(n + 1)
    if not n:
        return np.zeros(0, kind)
    order = suffix_order(symbols, length + 1)
    place = np.empty(n, kind)
    place[order] = np.arange(n, dtype=kind)
    before = np.where(order > 0, symbols[order - 1], 0).astype(np.int16)  # the transform
    step = place[order - 1]  # where the suffix one symbol longer is
    del place
    closed = np.zeros(n + 1, bool)
    low, high = np.array([0], kind), np.array([n], kind)
    for _ in range(length):
        size = high - low
        owner = np.repeat(np.arange(len(low), dtype=kind), size)
        at = np.arange(len(owner), dtype=kind) + (low - (np.cumsum(size, dtype=kind) - size))[owner]
        real = before[at] > 0
        owner, at = owner[real], at[real]
        if not len(at):
            break
        key = owner.astype(np.int64) * 257 + before[at]
        by = np.argsort(key, kind="stable")
        key, to = key[by], step[at[by]]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        low, high = np.minimum.reduceat(to, first), np.maximum.reduceat(to, first) + 1
        new = ~closed[high]
        low, high = low[new], high[new]
        closed[high] = True
        if not len(low):
            break
    # suffixes that start with a separator come first and are no windows
    classes = np.empty(n, kind)
    classes[order] = np.cumsum(closed[:n], dtype=kind)
    return classes
