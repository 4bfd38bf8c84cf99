"""Pruned dense top-k against brute force, and that cells are skipped."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlova.operators import dense_cells, similarity


def clustered(n, dim, centres, spread, seed):
    rng = np.random.default_rng(seed)
    around = rng.standard_normal((centres, dim))
    return around[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, dim))


def frames(spark, queries, docs):
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "qid bigint, vec array<double>")
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(docs)], "doc_id bigint, vec array<double>")
    return q, d


def unit(m):
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1, norms)


def brute(scores, k):
    rounded = np.round(scores, 9)
    out = {}
    for q, row in enumerate(rounded):
        hits = np.flatnonzero(row > 0)
        best = hits[np.lexsort((hits, -row[hits]))][:k]
        if len(best):
            out[q] = [(int(d), round(float(row[d]), 6)) for d in best]
    return out


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.qid, {})[r["rank"]] = (r.doc_id, round(round(r.score, 9), 6))
    return {q: [rows[i] for i in sorted(rows)] for q, rows in out.items()}


@pytest.mark.parametrize("seed,spread,block,queries", [(1, 0.05, 40, 7), (2, 1.0, 25, 1000), (3, 0.0, 30, 16)])
def test_dense_topk_equals_brute_force(spark, seed, spread, block, queries):
    """Clusters, no structure, and many copies of few vectors; zero vectors on both sides."""
    docs = clustered(500, 6, 9, spread, seed)
    docs[::50] = 0
    asked = np.concatenate([docs[3:60:2], clustered(20, 6, 3, 0.5, seed + 50), np.zeros((1, 6))])
    q, d = frames(spark, asked, docs)
    want = brute(np.clip(unit(asked) @ unit(docs).T, 0, 1), 4)
    assert result(similarity.dense_topk(q, d, 4, queries, block)) == want


def test_cells_are_skipped_and_documents_move_once(spark):
    docs = clustered(3000, 8, 30, 0.02, 5)
    q, d = frames(spark, docs[:300], docs)
    rows, rings = dense_cells.build_rings(d, 100)
    assert len(rings) > 25 and rows.count() == 3000
    assert rows.groupBy("block").count().agg(F.max("count")).first()[0] <= 110
    asked = q.withColumns({"_most": F.lit(0.0), "_kth": F.lit(0.99)})
    first = dense_cells.visits(asked, rings, 1.0, True)
    rest = dense_cells.visits(asked, rings, 1.0, False)
    assert first.count() == 300
    # Less than a third of all queries times rings.
    assert rest.count() < 300 * len(rings) / 3
    # Nothing that is skipped could have counted.
    met = first.select("qid", "block").union(rest.select("qid", "block")).collect()
    seen = {(r.qid, r.block) for r in met}
    block = {r.doc_id: r.block for r in rows.select("doc_id", "block").collect()}
    cosine = unit(docs[:300]) @ unit(docs).T
    assert all((int(i), block[int(j)]) in seen for i, j in np.argwhere(cosine >= 0.99))


def test_fused_topk_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    docs, asked = clustered(260, 5, 7, 0.1, 8), clustered(30, 5, 7, 0.1, 9)
    docs[:5] = 0
    dq, dd = frames(spark, asked, docs)
    weights = rng.random((260, 12)) * (rng.random((260, 12)) < 0.3)
    query_weights = rng.random((30, 12)) * (rng.random((30, 12)) < 0.3)
    sd = spark.createDataFrame([(f"f{f}", d, float(w)) for (d, f), w in np.ndenumerate(weights) if w], "feature string, doc_id bigint, w double")
    sq = spark.createDataFrame([(q, f"f{f}", float(w)) for (q, f), w in np.ndenumerate(query_weights) if w], "qid bigint, feature string, qw double")
    scores = 0.6 * np.clip(unit(asked) @ unit(docs).T, 0, 1) + query_weights @ weights.T
    assert result(similarity.fused_topk(dq, dd, sq, sd, 3, 0.6, 9, 20)) == brute(scores, 3)


def test_empty_sides(spark):
    q, d = frames(spark, np.ones((2, 3)), np.ones((2, 3)))
    assert similarity.dense_topk(q, d.limit(0), 2).collect() == []
    assert similarity.dense_topk(q.limit(0), d, 2).collect() == []
    assert len(similarity.dense_topk(q, d, 2).collect()) == 4


def test_a_query_that_visits_every_ring_is_repeated_in_bounded_steps():
    """Copies of a vector for all its rings must not fill one batch."""
    n, rings = 1500, 40
    found = dense_cells.Rings(np.eye(4), np.arange(rings) % 4, np.zeros(rings), np.full(rings, 3.2))
    rows = pd.DataFrame({"qid": np.arange(n), "vec": [[0.5, 0.5, 0.5, 0.5]] * n, "_most": 0.0, "_kth": 0.0})
    frame = SimpleNamespace(schema=[], mapInPandas=lambda run, _: run)
    sizes = [len(b) for b in dense_cells.visits(frame, found, 1.0, False)(iter([rows]))]
    assert sum(sizes) == n * (rings - 1) and max(sizes) <= 8192


def test_cells_run_once_however_often_the_result_is_read(spark, tmp_path):
    import tempfile

    rows = clustered(120, 6, 4, 0.2, 3)
    q, d = frames(spark, rows[:30], rows)
    plain, at = similarity._dense_cell(3), str(tmp_path)

    def cell(left, right):
        tempfile.mkstemp(dir=at)
        return plain(left, right)

    asked = q.withColumn("_most", F.lit(0.0))
    hits = dense_cells.ring_topk(asked, d, 3, cell, "qid bigint, doc_id bigint, score double", similarity.best_first(), 1.0, 20, 16)
    ran = len(list(tmp_path.iterdir()))
    assert ran and hits.count() == 90 and hits.join(hits.groupBy("qid").count(), "qid").count() == 90
    assert len(list(tmp_path.iterdir())) == ran


def rows_of(df):
    return sorted(((r.qid is None, r.qid, r["rank"], r.doc_id is None, r.doc_id, round(round(r.score, 9), 6)) for r in df.collect()), key=str)


def test_queries_that_need_most_rings_are_not_repeated(spark, monkeypatch):
    """Data without structure: no vector is sent to every ring. Rows as with one ring, also where ids repeat or are null."""
    rng = np.random.default_rng(21)
    vectors = [[float(x) for x in v] for v in rng.standard_normal((300, 12))]
    docs = [(None if i % 41 == 0 else i // 2 if i % 10 == 0 else i, v) for i, v in enumerate(vectors)]
    asked = [(None if i % 17 == 0 else i // 3, v) for i, v in enumerate(vectors[:90])] + [(500, [0.0] * 12)]
    d = spark.createDataFrame(docs, "doc_id bigint, vec array<double>")
    q = spark.createDataFrame(asked, "qid bigint, vec array<double>")
    want = rows_of(similarity.dense_topk(q, d, 4, 50, 1000))
    plain, crossed = dense_cells.visits, []
    monkeypatch.setattr(dense_cells, "visits", lambda *a: plain(*a) if a[3] else pytest.fail("queries were sent to all their rings"))
    cross = getattr(dense_cells, "_cross", None)
    monkeypatch.setattr(dense_cells, "_cross", lambda *a: crossed.append(a[2:4]) or cross(*a), raising=False)
    got = rows_of(similarity.dense_topk(q, d, 4, 25, 40))
    assert got == want and len(want) > 100 and min(crossed[0]) > 3


def test_queries_that_need_few_rings_are_sent_there(spark, monkeypatch):
    docs = clustered(600, 6, 12, 0.001, 4)
    q, d = frames(spark, docs[:50], docs)
    monkeypatch.setattr(dense_cells, "_cross", lambda *_: pytest.fail("all blocks met"))
    assert result(similarity.dense_topk(q, d, 3, 30, 50)) == brute(np.clip(unit(docs[:50]) @ unit(docs).T, 0, 1), 3)


def test_a_cell_returns_only_what_can_still_count():
    """Scores of terms and vectors together, of blocks as they arrive; below the k-th score so far nothing leaves a cell."""
    rng = np.random.default_rng(3)
    docs, asked = rng.standard_normal((40, 5)), rng.standard_normal((9, 5))
    asked[4] = 0
    w, qw = rng.random((40, 7)) * (rng.random((40, 7)) < 0.4), rng.random((9, 7)) * (rng.random((9, 7)) < 0.6)
    names = np.array([f"f{i}" for i in range(7)])

    def table(key, vectors, weights, name):
        some = [None if not r.any() else r > 0 for r in weights]
        return pa.table(
            {
                key: pa.array(range(len(vectors))),
                "vec": pa.array([list(v) for v in vectors]),
                "feature": pa.array([None if s is None else list(names[s]) for s in some], pa.list_(pa.string())),
                name: pa.array([None if s is None else list(r[s]) for s, r in zip(some, weights)], pa.list_(pa.float64())),
            }
        )

    scores = 0.6 * np.clip(unit(asked) @ unit(docs).T, 0, 1) + qw @ w.T
    kth = np.sort(scores, axis=1)[:, -2]
    q, d = table("qid", asked, qw, "qw"), table("doc_id", docs, w, "w")
    every = similarity._fused_cell(4, 0.6)(q, d)
    few = similarity._fused_cell(4, 0.6)(q.append_column("_kth", pa.array(kth)), d.take(pa.array(rng.permutation(40))))
    for found, k in ((every, 4), (few, 2)):
        got = {}
        for r in found.to_pylist():
            got.setdefault(r["qid"], []).append((r["doc_id"], round(round(r["score"], 9), 6)))
        assert got == brute(scores, k)
