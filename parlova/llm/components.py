"""Connected components of link tables, without gathering them anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlova.runtime import materialize

MAX_ROUNDS = 60


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bounded batch reduced to (node, smallest node of its component)."""
    if not len(a):
        return a, b
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (its smallest reachable node) for every node of ``links(a, b)``.

    Alternates two star steps: link the larger neighbours of each node to its smallest
    neighbour, then the smaller ones. The rounds needed grow with the logarithm of the
    component size. Every round is a written table, so a lost executor costs one round. Null
    ends and loops are ignored; a root is not listed itself.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(
        links.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        new = materialize(moved.union(least.select("a", F.col("m").alias("b"))).distinct())
        new_state = _state(new)
        edges = new
        if new_state == state:
            break
        state = new_state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(a.alias("node"), b.alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free digest; equal states mean that a round changed nothing."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row.n, row.h
