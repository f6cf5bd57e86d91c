"""Suffix arrays in numpy: refinement of unsorted groups by doubled prefixes, and common prefixes by Kasai's rule."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each suffix) of an array of bytes.

    Larsson and Sadakane's refinement: suffixes are grouped by their first h bytes; a group is sorted by the group of
    the suffix h further on, which doubles h; groups of one are done and never touched again. Shorter suffixes come
    first.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    for j in range(7):  # 257 letters with the end: seven of them fit in 64 bits
        key = key * np.uint64(257) + padded[j : j + n]
    order = np.argsort(key, kind="stable")
    first = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.zeros(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    h = 7
    while True:
        alone = first & np.concatenate([first[1:], [True]])
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order, rank
        here = order[slots]
        ahead = np.where(here + h < n, rank[np.minimum(here + h, n - 1)] + 1, 0)
        pair = rank[here] * (n + 1) + ahead
        sort = np.argsort(pair, kind="stable")
        order[slots], pair = here[sort], pair[sort]
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        first[slots] = new
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, cap: int) -> np.ndarray:
    """Length, up to cap, of what each suffix in order has in common with the one before it.

    Kasai's rule: the suffix that starts one byte later has at most one byte less in common. It's followed from every
    start to the next one, in all of these stretches at once.
    """
    n = len(text)
    lcp, at = np.zeros(n, dtype=np.int64), starts.astype(np.int64)
    end = np.concatenate([at[1:], [n]])
    length = np.zeros(len(at), dtype=np.int64)
    while len(at):
        here = rank[at]
        before = order[np.maximum(here - 1, 0)]
        length = np.where(here > 0, np.maximum(length - 1, 0), 0)
        live = np.flatnonzero(here > 0)
        while len(live):
            a, b = at[live] + length[live], before[live] + length[live]
            live, a, b = (x[(a < n) & (b < n) & (length[live] < cap)] for x in (live, a, b))
            live = live[text[a] == text[b]]
            length[live] += 1
        lcp[here] = length
        at = at + 1
        on = at < end
        at, end, length = at[on], end[on], length[on]
    return lcp


def repeated_windows(text: np.ndarray, starts: np.ndarray, owners: np.ndarray, width: int) -> np.ndarray:
    """For each window of a text made of segments, the smallest owner of a segment with an equal window.

    starts and owners are the segments'. Windows that reach over a segment's end get the largest integer.
    """
    n = len(text)
    least = np.full(n, np.iinfo(np.int64).max)
    if not n:
        return least
    order, rank = suffix_array(text)
    group = np.cumsum(common_prefixes(text, order, rank, starts, width) < width)
    ends = np.concatenate([starts[1:], [n]])
    segment = np.repeat(np.arange(len(starts)), ends - starts)
    valid = np.arange(n) + width <= ends[segment]
    slots = np.flatnonzero(valid[order])
    if len(slots):
        ids = group[slots]
        heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        smallest = np.minimum.reduceat(owners[segment[order[slots]]], heads)
        least[order[slots]] = np.repeat(smallest, np.diff(np.concatenate([heads, [len(ids)]])))
    return least
