"""Run-length grammars by recompression, and longest common extensions on them.

Rounds alternate: block compression replaces a maximal run of one symbol by a symbol of its own,
pair compression replaces neighbours (a, b) with a on the left and b on the right side of a partition
of the symbols. Both decide by the symbols alone, so equal parts of the text are parsed alike but for
a bounded number of symbols at each edge. An extension climbs while both places begin a symbol and
agree, and descends where they differ: a few steps per round. All questions go through the rounds
together, as arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# A grammar has some log(n) / log(4/3) rounds of pairs; more than this many without an effect end it.
_IDLE_ROUNDS = 24


@dataclass(frozen=True)
class Round:
    """The symbols before a round, and the symbol after it that each belongs to."""

    symbol: np.ndarray
    parent: np.ndarray
    starts: np.ndarray  # the first symbol of its parent
    child: np.ndarray  # per parent its first symbol, and the end

    def mirrored(self) -> Round:
        n, m = len(self.symbol), len(self.child) - 1
        parent = (m - 1) - self.parent[::-1]
        child = n - self.child[::-1]
        starts = np.zeros(n, bool)
        starts[child[:-1]] = True
        return Round(self.symbol[::-1], parent, starts, child)


@dataclass(frozen=True)
class Grammar:
    """Rounds from the text upwards, and the symbols that are left."""

    rounds: list[Round]
    top: np.ndarray
    n: int

    def mirrored(self) -> Grammar:
        return Grammar([r.mirrored() for r in self.rounds], self.top[::-1], self.n)


def _round(symbol: np.ndarray, starts: np.ndarray) -> Round:
    child = np.append(np.flatnonzero(starts), len(symbol))
    parent = np.cumsum(starts, dtype=np.int64) - 1
    return Round(symbol, parent, starts, child)


def _sides(symbol: np.ndarray, number: int) -> np.ndarray:
    """The right side of a partition of the symbols that changes with every round."""
    h = (symbol.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * number)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)) & np.uint64(1) == 1


def _named(a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """New symbols for pairs of numbers, equal exactly where the pairs are."""
    _, low = np.unique(b, return_inverse=True)
    width = int(low.max()) + 1 if len(low) else 1
    _, name = np.unique(a * width + low, return_inverse=True)
    return base + name.astype(np.int64)


def grammar(text: np.ndarray, n_fixed: int = 0) -> Grammar:
    """The grammar of a sequence of numbers.

    The numbers ``0 .. n_fixed - 1`` end a text: each occurs once and joins no other.
    """
    symbol = text.astype(np.int64)
    rounds: list[Round] = []
    base = int(symbol.max()) + 1 if len(symbol) else 0
    idle = number = 0
    while len(symbol) > 1 and idle < _IDLE_ROUNDS:
        same = np.zeros(len(symbol), bool)
        same[1:] = symbol[1:] == symbol[:-1]
        if same.any():
            step = _round(symbol, ~same)
            size = np.diff(step.child)
            above = symbol[step.child[:-1]]
            many = np.flatnonzero(size > 1)
            above[many] = _named(above[many], size[many], base)
            base = max(base, int(above.max()) + 1)
            rounds.append(step)
            symbol = above
        free = symbol >= n_fixed
        if not (free[1:] & free[:-1]).any():
            break
        right = _sides(symbol, number)
        number += 1
        joins = np.zeros(len(symbol), bool)
        joins[1:] = free[1:] & free[:-1] & right[1:] & ~right[:-1]
        if not joins.any():
            idle += 1
            continue
        idle = 0
        step = _round(symbol, ~joins)
        first = step.child[:-1]
        above = symbol[first]
        two = np.flatnonzero(np.diff(step.child) == 2)
        above[two] = _named(above[two], symbol[first[two] + 1], base)
        base = max(base, int(above.max()) + 1)
        rounds.append(step)
        symbol = above
    return Grammar(rounds, symbol, len(text))


def _skip(step: Round, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Symbols both places can pass at once: one, or what is left of both blocks."""
    left = np.minimum(step.child[step.parent[i] + 1] - i, step.child[step.parent[j] + 1] - j)
    block = step.symbol[np.maximum(i, 1) - 1] == step.symbol[i]
    block |= step.symbol[np.minimum(i + 1, len(step.symbol) - 1)] == step.symbol[i]
    return np.where(block, left, 1)


def common_extension(g: Grammar, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols of the text agree from the places ``i`` and ``j`` (i != j) on.

    The text must end with a symbol that occurs once.
    """
    at_i, at_j = i.astype(np.int64), j.astype(np.int64)
    turned = np.full(len(i), len(g.rounds), np.int64)
    up = np.arange(len(i))
    for h, step in enumerate(g.rounds):
        a, b = at_i[up], at_j[up]
        equal = step.symbol[a] == step.symbol[b]
        inside = equal & ~(step.starts[a] & step.starts[b])
        move = np.flatnonzero(inside)
        if len(move):
            by = _skip(step, a[move], b[move])
            a[move] += by
            b[move] += by
            equal[move] = (step.symbol[a[move]] == step.symbol[b[move]]) & step.starts[a[move]] & step.starts[b[move]]
        at_i[up], at_j[up] = a, b
        turned[up[~equal]] = h
        up = up[equal]
        at_i[up], at_j[up] = step.parent[at_i[up]], step.parent[at_j[up]]
        if not len(up):
            break
    while len(up):
        up = up[g.top[at_i[up]] == g.top[at_j[up]]]
        at_i[up] += 1
        at_j[up] += 1
    for h in range(len(g.rounds) - 1, -1, -1):
        step = g.rounds[h]
        above = np.flatnonzero(turned > h)
        at_i[above], at_j[above] = step.child[at_i[above]], step.child[at_j[above]]
        here = np.flatnonzero(turned >= h)
        here = here[step.symbol[at_i[here]] == step.symbol[at_j[here]]]
        while len(here):
            by = _skip(step, at_i[here], at_j[here])
            at_i[here] += by
            at_j[here] += by
            here = here[step.symbol[at_i[here]] == step.symbol[at_j[here]]]
    return at_i - i
