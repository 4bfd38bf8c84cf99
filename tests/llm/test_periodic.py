from __future__ import annotations

import random
import time

import numpy as np
import pytest

from parlova.llm.periodic import op11_periodic, periodic_runs, runs_of
from parlova.llm.queries import queries
from parlova.llm.recompression import common_extension, grammar

from llm import reference

SF = "/root/testdata/sf0.001"


def _numbers(texts):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.array([w for t in texts for w in t], np.int64), first


def test_extensions_match_plain_comparison():
    rng = random.Random(3)
    for _ in range(60):
        n, letters = rng.choice([2, 9, 60, 300]), rng.choice([1, 2, 4])
        body = [rng.randrange(letters) + 2 for _ in range(n)]
        if rng.random() < 0.5:
            body = (body[: 1 + n // 7] * n)[:n]
        text = np.array([0, *body, 1])
        forward = grammar(text, 2)
        backward = forward.mirrored()
        pairs = [p for p in ((rng.randrange(1, n + 1), rng.randrange(1, n + 1)) for _ in range(80)) if p[0] != p[1]]
        if not pairs:
            continue
        i, j = np.array(pairs).T
        plain = [next(k for k in range(n + 1) if text[a + k] != text[b + k]) for a, b in pairs]
        assert common_extension(forward, i, j).tolist() == plain
        plain = [next(k for k in range(n + 1) if text[a - 1 - k] != text[b - 1 - k]) for a, b in pairs]
        assert common_extension(backward, len(text) - i, len(text) - j).tolist() == plain


@pytest.mark.parametrize("min_length,exponent", [(6, 4), (2, 2), (9, 3)])
def test_runs_match_brute_force(min_length, exponent):
    rng = random.Random(exponent)
    for _ in range(150):
        texts = []
        for _ in range(rng.choice([1, 2, 6])):
            n, letters = rng.choice([0, 1, 5, 12, 40, 90]), rng.choice([1, 2, 3, 5])
            text = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                text = [text[a + (i - a) % p] if i >= a else w for i, w in enumerate(text)]
            texts.append(text)
        got = runs_of(*_numbers(texts), min_length, exponent).tolist()
        assert got == [[t, *r] for t, text in enumerate(texts) for r in reference.runs(text, min_length, exponent)]


def test_runs_of_very_long_texts_take_seconds():
    n = 300_000
    fibonacci = [0]
    before = [1]
    while len(fibonacci) < n:
        fibonacci, before = fibonacci + before, fibonacci
    started = time.time()
    assert runs_of(*_numbers([[7] * n])).tolist() == [[0, 0, n, 1]]
    assert runs_of(*_numbers([list(range(777)) * (n // 777)])).tolist() == [[0, 0, n // 777 * 777, 777]]
    assert len(runs_of(*_numbers([fibonacci[:n]]))) == 0
    assert time.time() - started < 60


def test_rows_ties_nulls_and_clashing_names(spark):
    texts = [
        None, "", " \t\n", "one", "a a a a a", "a a a a a a", "x\ty x\ny  x y x y", "é ß é ß é ß é ß é", "a a a a a a b b b b b b",
        "w " * 9 + "z " + "w " * 9, "x y x y x y x y x y x y x x x x x x x", "n " * 20_000, "long" * 50_000,
    ]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "a a a a a a", "clash", 2), (3, "one", "clash", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, N_WORDS int")
    got = periodic_runs(docs).collect()
    assert len(got) == len(rows)
    want = []
    for doc_id, text, _, _ in rows:
        found = reference.words(text)
        runs = reference.runs(found)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        want.append((doc_id, len(found), runs, " ".join(w for i, w in enumerate(found) if i not in gone)))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(want, key=key)
    assert periodic_runs(docs.limit(0)).collect() == []


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.asDict() for r in queries()["op11_periodic"](spark, SF).collect()}
    assert len(got) == len(docs)
    assert sum(r["n_runs"] > 0 for r in got.values()) > 5
    for doc_id, text in docs:
        assert got[doc_id] == reference.periodic(doc_id, text)


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([None, "", " ", "a", "b a " * 30, "a b\tc " * 50] * 12)] + [(None, "a " * 9)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.asDict() for r in op11_periodic(spark, str(tmp_path)).collect()]
    want = [reference.periodic(d, t) for d, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
