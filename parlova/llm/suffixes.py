"""Suffix arrays and permuted common prefixes of number sequences."""

from __future__ import annotations

import numpy as np


def suffix_array(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Order of all suffixes; a suffix ends where its owner ends.

    Ranks of windows of 1, 2, 4 … values; each round sorts only suffixes that still
    share their rank. Suffixes of different owners never share one.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    key = owner.astype(np.int64) * (int(values.max()) + 1) + values
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    place = np.arange(n)
    lone = new & np.concatenate([new[1:], [True]])
    place, open_ = place[~lone], order[~lone]
    width = 1
    while len(open_):
        nxt = open_ + width
        inside = nxt < n
        tail = np.zeros(len(open_), np.int64)
        ok = np.flatnonzero(inside)
        ok = ok[owner[nxt[ok]] == owner[open_[ok]]]
        tail[ok] = rank[nxt[ok]] + 1
        head = rank[open_]
        # Open suffixes lie by rank already; ties stay open, in any order.
        pair = head * (n + 1) + tail
        by = np.argsort(pair)
        open_, pair = open_[by], pair[by]
        order[place] = open_
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[open_] = place[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        lone = new & np.concatenate([new[1:], [True]])
        place, open_ = place[~lone], open_[~lone]
        width *= 2
    return order


def permuted_lcp(values: np.ndarray, owner: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix, in text order, its common prefix with the suffix sorted before it.

    Where the predecessor of suffix i is the successor of the predecessor of i - 1, and
    these two begin alike, the prefix is one shorter; the other places are compared value
    by value.
    """
    n = len(values)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    same = np.zeros(n, bool)
    has = before >= 0
    same[has] = owner[before[has]] == owner[has.nonzero()[0]]
    follows = np.zeros(n, bool)
    follows[1:] = same[1:] & same[:-1] & (before[1:] == before[:-1] + 1) & (owner[1:] == owner[:-1])
    follows[1:] &= values[:-1] == values[before[:-1]]
    lcp = np.zeros(n, np.int64)
    place = np.flatnonzero(same & ~follows)
    other, depth = before[place], 0
    while len(place):
        a, b = place + depth, other + depth
        ok = (a < n) & (b < n)
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        ok &= (owner[a] == owner[place]) & (owner[b] == owner[other]) & (values[a] == values[b])
        lcp[place[~ok]] = depth
        place, other, depth = place[ok], other[ok], depth + 1
    head = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    reducible = np.flatnonzero(follows)
    lcp[reducible] = np.maximum(0, lcp[head[reducible]] - (reducible - head[reducible]))
    return lcp


def repeat_length(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place, the longest string from there that also starts elsewhere in its owner."""
    longest = lcp.copy()
    np.maximum.at(longest, order[:-1], lcp[order[1:]])
    return longest
