from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlova.llm import hash_forest
from parlova.llm.hash_forest import Hasher, Parts, enough, nearest, prefix_ranges
from parlova.llm.queries import queries

SCHEMA = "vec_id bigint, embedding array<float>, rank string, SCORE int"
ASKS = "vec_id % 20 = 0"


def product(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def brute(rows, k=20):
    """(query, rank, id, score) by definition, on float components."""
    good = []
    for vec_id, vector in rows:
        if vec_id is None or not vector or any(x is None or not math.isfinite(x) for x in vector) or not any(vector):
            continue
        good.append((vec_id, [float(np.float32(x)) for x in vector]))
    size = max((len(v) for _, v in good), key=lambda n: (sum(len(v) == n for _, v in good), n), default=0)
    good = sorted({(i, tuple(v)) for i, v in good if len(v) == size})
    out = []
    for q, a in good:
        if q % 20 == 0:
            scored = sorted((-product(a, b), i) for i, b in good if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def got_of(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA)


def random_rows(n, dim, seed, copies=0, lengths=False):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    if lengths:
        x *= rng.lognormal(0, 1, (n, 1)).astype(np.float32)
    x[:copies] = x[0]
    order = rng.permutation(n)
    return [(int(i), [float(c) for c in x[at]]) for i, at in enumerate(order)]


@pytest.mark.parametrize("n,dim,copies", [(300, 8, 0), (260, 5, 110), (20, 3, 4), (5, 3, 0)])
def test_from_the_root_all_rows_are_searched(spark, monkeypatch, n, dim, copies):
    """A recall that no sample reaches asks for every row: the result is exact, also over many small parts."""
    monkeypatch.setattr(hash_forest, "PART_ROWS", 23)
    monkeypatch.setattr(hash_forest, "PART_QUERIES", 2)
    rows = random_rows(n, dim, n, copies, lengths=True)
    assert got_of(nearest(table(spark, rows), F.expr(ASKS), trees=3, depth=2, target_recall=2)) == brute(rows)


def test_odd_rows(spark):
    rows = random_rows(60, 4, 7)
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [1.0, nan, 0.0, 0.0], [inf, 0.0, 0.0, 0.0], [1.0], [-0.0, 1.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]]
    rows += [(100 + 20 * i, v) for i, v in enumerate(odd)] + [(None, [1.0, 2.0, 3.0, 4.0]), rows[0], rows[20], rows[20]]
    assert got_of(nearest(table(spark, rows), F.expr(ASKS), trees=4, depth=3, target_recall=2)) == brute(rows)
    assert nearest(table(spark, []), F.expr(ASKS)).collect() == []
    assert nearest(table(spark, [(0, None), (20, [0.0])]), F.expr(ASKS)).collect() == []
    assert nearest(table(spark, [(20, [1.0, 2.0])]), F.expr(ASKS)).collect() == []
    assert nearest(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 3.0])]), F.expr(ASKS)).collect() == []


def test_parts_meet_every_pair_once():
    rng = np.random.default_rng(2)
    rows, asked = rng.integers(0, 40, (2, 6)), rng.integers(0, 9, (2, 6))
    rows[0, 2], asked[0, 3], rows[1, 5], asked[1, 5] = 500, 300, 450, 200
    saved = hash_forest.PART_ROWS, hash_forest.PART_QUERIES
    hash_forest.PART_ROWS, hash_forest.PART_QUERIES = 100, 50
    try:
        parts = Parts.plan(rows, asked)
    finally:
        hash_forest.PART_ROWS, hash_forest.PART_QUERIES = saved
    seen = set()
    for tree in range(2):
        for digit in range(6):
            n, m = 40, 30
            which, part = parts.of_rows(tree, np.full(n, digit), np.arange(n) * 7)
            q_which, q_part = parts.of_queries(tree, np.full(m, digit), np.arange(m) * 5)
            met = [(int(a), int(b)) for a, p in zip(which, part) for b, r in zip(q_which, q_part) if p == r]
            assert len(met) == len(set(met)) == n * m
            seen.add((tree, *sorted(set(part.tolist()))))
    assert not {p for t, *ps in seen if t == 0 for p in ps} & {p for t, *ps in seen if t == 1 for p in ps}


def test_prefix_ranges():
    rng = random.Random(5)
    ordered = np.sort(np.array([rng.getrandbits(32) & 0x03030303 for _ in range(400)], np.uint64))
    wanted = np.array([rng.getrandbits(32) & 0x03030303 for _ in range(50)], np.uint64)
    for level in range(5):
        rest = 8 * (4 - level)
        start, stop = prefix_ranges(ordered, wanted, np.full(50, level), np.full(50, rest))
        for w, a, b in zip(wanted, start, stop):
            assert [int(o) >> rest == int(w) >> rest for o in ordered] == [a <= i < b for i in range(400)]


def test_enough_is_the_least_that_reaches_the_target():
    counts = np.array([[50, 5, 1], [40, 20, 2], [9, 9, 9]])
    reach, query = np.array([0, 1, 2, 3, 1, 1, 3]), np.array([0, 0, 0, 1, 1, 1, 2])

    def recall(m):
        level = (counts >= m).sum(axis=1)
        return np.mean([np.mean(reach[query == q] >= level[q]) for q in range(3)])

    for target in (0.1, 0.5, 0.8, 0.9, 1.0):
        m = enough(counts, reach, query, target)
        if m == math.inf:
            assert all(recall(x) < target for x in np.unique(counts))
        else:
            assert recall(m) >= target
            assert all(recall(x) < target for x in np.unique(counts) if x < m)


def test_equal_vectors_have_equal_strings_at_any_length():
    hasher = Hasher(4, 8.0, 3, 4)
    x = np.array([[1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0]], np.float32)
    strings = hasher.strings(hasher.queries(x), hasher.rotations())
    assert (strings[0] == strings[1]).all()


def test_query_reaches_the_recall(spark):
    path = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute([(r.vec_id, r.embedding) for r in rows])
    got = queries()["op12_neighbours"](spark, path)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    got = got_of(got)
    assert [(q, r) for q, r, _, _ in got] == [(q, r) for q, r, _, _ in want]
    exact = {(q, i): s for q, _, i, s in want}
    hits = [(q, i) for q, _, i, _ in got if (q, i) in exact]
    assert len(hits) >= 0.9 * len(want)
    assert all(s == exact[q, i] for q, _, i, s in got if (q, i) in exact)


def test_a_vector_of_a_third_of_all_rows(spark):
    """Copies are searched once; their lists are their own smallest ids."""
    rows = random_rows(1500, 16, 3, copies=500)
    got = got_of(nearest(table(spark, rows), F.expr(ASKS), trees=16, depth=3))
    want = brute(rows)
    assert [(q, r) for q, r, _, _ in got] == [(q, r) for q, r, _, _ in want]
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
