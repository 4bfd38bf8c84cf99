"""Suffix arrays by induced sorting, an array of suffixes at a time."""

from __future__ import annotations

import numpy as np

from parlova.llm.suffixes import suffix_array

# Up to so many distinct names a reduced string is sorted by this module again; above, buckets
# hold too few suffixes each to be worth an array operation, and ranks are doubled instead.
MAX_BUCKETS = 2048


def _is_s(s: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor; the last one is not."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int32) - s[:-1].astype(np.int32))
    step[-1] = -1
    decided = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(decided[::-1])[::-1]
    return step[following] > 0


def _induce(s: np.ndarray, is_s: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost smaller ones in order (``lms``).

    Buckets of equal first values are walked upwards, where sorted suffixes place larger
    predecessors at bucket heads, and then downwards, where they place smaller ones at the ends. A
    bucket is taken in waves, as its own suffixes may place others in it.
    """
    n, k = len(s), len(starts) - 1
    order = np.full(n, -1, np.int64)
    head = starts[:-1].copy()
    firsts = s[lms]
    lms_bound = np.searchsorted(firsts, np.arange(k + 1))

    def place(found: np.ndarray, larger: bool) -> None:
        before = found[found > 0] - 1
        before = before[is_s[before] != larger]
        if not len(before):
            return
        value = s[before]
        by = np.argsort(value, kind="stable")
        value, before = value[by], before[by]
        count = np.bincount(value, minlength=k)
        rank = np.arange(len(value)) - (np.cumsum(count) - count)[value]
        if larger:
            order[head[value] + rank] = before
            head[:] += count
        else:
            order[head[value] - 1 - rank] = before
            head[:] -= count

    last = int(s[n - 1])
    order[head[last]] = n - 1
    head[last] += 1
    for c in range(k):
        if starts[c] == starts[c + 1]:
            continue
        done = starts[c]
        while done < head[c]:
            wave = order[done : head[c]]
            done = head[c]
            place(wave, True)
        place(lms[lms_bound[c] : lms_bound[c + 1]], True)
    l_end = head.copy()
    head = starts[1:].copy()
    for c in range(k - 1, -1, -1):
        if starts[c] == starts[c + 1]:
            continue
        done = starts[c + 1]
        while head[c] < done:
            wave = order[head[c] : done][::-1]
            done = head[c]
            place(wave, False)
        place(order[starts[c] : l_end[c]][::-1], False)
    return order


def induced_suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """The order of all suffixes of ``s`` (values below ``k``); a prefix sorts before what extends it."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    is_s = _is_s(s)
    starts = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=k))])
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if not len(lms):
        return _induce(s, is_s, starts, lms)
    # Leftmost smaller substrings: sorted by first value only, inducing sorts them whole.
    order = _induce(s, is_s, starts, lms[np.argsort(s[lms], kind="stable")])
    number = np.full(n, -1, np.int64)
    number[lms] = np.arange(len(lms))
    ranked = order[number[order] >= 0]
    length = np.append(np.diff(lms) + 1, n - lms[-1])[number[ranked]]
    same = np.zeros(len(ranked), bool)
    # The last of them runs into the end of the string and equals no other.
    at = np.flatnonzero((length[1:] == length[:-1]) & (ranked[1:] != lms[-1]) & (ranked[:-1] != lms[-1])) + 1
    depth = 0
    while len(at):
        whole = depth >= length[at]
        same[at[whole]] = True
        at = at[~whole]
        at = at[s[ranked[at] + depth] == s[ranked[at - 1] + depth]]
        depth += 1
    name = np.cumsum(~same) - 1
    reduced = np.empty(len(lms), np.int64)
    reduced[number[ranked]] = name
    distinct = int(name[-1]) + 1
    if distinct == len(lms):
        by = number[ranked]
    elif distinct <= MAX_BUCKETS:
        by = induced_suffix_array(reduced.astype(np.uint16), distinct)
    else:
        by = suffix_array(reduced, np.zeros(len(reduced), np.int64))
    return _induce(s, is_s, starts, lms[by])


def byte_lcp(data: np.ndarray, end: np.ndarray, order: np.ndarray, least: int = 0) -> np.ndarray:
    """Permuted common prefixes: for each place, with the suffix sorted before it.

    ``end`` is where the string that holds a place ends; prefixes are cut there. Where a
    place's predecessor follows the predecessor of the place before, the prefix is one
    shorter; elsewhere eight bytes are compared at a time. Where either suffix is shorter
    than ``least`` the prefix may be given as 0.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    words = np.zeros(n + 8, np.uint64)
    for j in range(8):
        words |= padded[j : j + n + 8] << np.uint64(8 * j)
    at = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    room = end - at >= least
    use = (before >= 0) & room & room[before]
    follows = np.zeros(n, bool)
    follows[1:] = use[1:] & (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (end[1:] == end[:-1])
    full = np.zeros(n, np.int64)
    place = np.flatnonzero(use & ~follows)
    full[place] = _compare(words, end, place, before[place], n)
    head = np.maximum.accumulate(np.where(follows, 0, at))
    lcp = full[head] - (at - head)
    # Behind an end the chain starts anew: compare those places by themselves.
    lost = np.flatnonzero(follows & (lcp <= 0))
    lcp = np.maximum(lcp, 0)
    if len(lost):
        lcp[lost] = _compare(words, end, lost, before[lost], n)
    return lcp


def _compare(words: np.ndarray, end: np.ndarray, place: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(place), np.int64)
    limit = np.minimum(end[place] - place, end[other] - other)
    at, depth = np.arange(len(place)), 0
    while len(at):
        differ = words[np.minimum(place[at] + depth, n)] ^ words[np.minimum(other[at] + depth, n)]
        same = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        same[differ == 0] = 8
        stop = (same < 8) | (depth + 8 >= limit[at])
        out[at[stop]] = np.minimum(depth + same[stop], limit[at[stop]])
        at, depth = at[~stop], depth + 8
    return out
