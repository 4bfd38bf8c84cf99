from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from parlova.llm import batches, exact_substrings
from parlova.llm.exact_substrings import owners, remove_repeats, rolling_hashes
from parlova.llm.induced import byte_lcp, induced_suffix_array
from parlova.llm.suffixes import suffix_array


def brute(rows, window):
    """rows: (doc_id, text); the contract's figures in row order."""
    texts = [(t or "").encode() for _, t in rows]
    first: dict[bytes, int] = {}
    big = 1 << 62
    ids = [big if i is None else i for i, _ in rows]
    for i, t in zip(ids, texts):
        for p in range(len(t) - window + 1):
            w = t[p : p + window]
            first[w] = min(first.get(w, big), i)
    out = []
    for i, t in zip(ids, texts):
        gone = [False] * len(t)
        for p in range(len(t) - window + 1):
            if first[t[p : p + window]] < i:
                gone[p : p + window] = [True] * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def check(spark, rows, window=50, anchor=24, **options):
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, batch int")
    got = remove_repeats(docs, window=window, anchor=anchor, keep_bytes=True, **options).collect()
    want = brute(rows, window)
    assert sorted((str(r[0]), *r[1:5], bytes(r[5])) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want))


def passages(seed, n_docs):
    rng = random.Random(seed)
    letters = "abcdefghij  \nöß"
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(30, 160))) for _ in range(12)]
    rows = []
    for i in range(n_docs):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randint(1, 90))))
        rows.append((i, "".join(parts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("options", [{}, {"batch_bytes": 700, "hot_docs": 4}])
def test_matches_brute_force(spark, seed, options):
    check(spark, passages(seed, 60), **options)


def test_odd_rows(spark):
    block = "the same fifty and some more bytes are in all of these documents here"
    rows = [
        (5, None), (6, ""), (7, "short"), (3, block), (None, block), (None, "x" + block), (4, block + " end"), (4, block + " end"),
        (9, "z" * 300), (8, "z" * 120), (10, "ab" * 200), (11, "ba" * 60 + block), (12, "x" * 49), (13, "x" * 49),
    ]
    check(spark, rows, batch_bytes=150)
    check(spark, rows, hot_docs=1)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i: w[:4] for (i, _), w in zip(rows, brute(rows, 50))}
    assert {r[0]: tuple(r[1:5]) for r in remove_repeats(docs).collect()} == want
    assert sum(w[1] for w in want.values()) > 0


def test_induced_order_and_prefixes():
    rng = np.random.default_rng(7)
    for trial in range(200):
        n, k = int(rng.integers(1, 70)), int(rng.integers(1, 5))
        s = rng.integers(0, k, n).astype(np.uint16)
        if trial % 3 == 0:
            s = np.tile(s, 3)
        raw = s.astype(np.uint8).tobytes()
        order = induced_suffix_array(s, k)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        assert order.tolist() == suffix_array(s.astype(np.int64), np.zeros(len(s), np.int64)).tolist()
        lcp = byte_lcp(np.frombuffer(raw, np.uint8), np.full(len(raw), len(raw)), order)
        for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
            same = 0
            while b + same < len(raw) and a + same < len(raw) and raw[a + same] == raw[b + same]:
                same += 1
            assert lcp[b] == same


def test_owners_and_hashes():
    strings = [b"abcabc", b"xabcx", b"abc", b"bca"]
    data = np.frombuffer(b"".join(strings), np.uint8)
    bounds = np.cumsum([0, *map(len, strings)])
    least = np.array([4, 2, 7, 1])
    got = owners(data, bounds, least, 3)
    for i, s in enumerate(strings):
        for p in range(len(s)):
            w = s[p : p + 3]
            want = min((int(m) for m, t in zip(least, strings) if w in t), default=None) if len(w) == 3 else np.iinfo(np.int64).max
            assert got[bounds[i] + p] == want
    h = rolling_hashes(np.frombuffer(b"hello hello hello", np.uint8), 5)
    assert len(h) == 13 and h[0] == h[6] == h[12] and len(set(h.tolist())) == 6


def test_parts_of_a_shard_change_no_answer():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 101, 6000).astype(np.uint8)
    rows = []
    for number in range(3):
        docs = [np.concatenate([text[a : a + 400], rng.integers(97, 123, 100).astype(np.uint8)]) for a in rng.integers(0, 5500, 20)]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        rows.append({"batch": number, "ids": np.arange(20) * 3 + number, "offsets": offsets, "data": np.concatenate(docs), "shared": []})
    keys = [exact_substrings.anchored(r["data"], r["offsets"], 50, 24) for r in rows]
    for row in rows:
        row["shared"] = [
            {"bucket": 0, "keys": raw, "hot": np.packbits(np.zeros(len(raw) // 5, bool)).tobytes()}
            for key in keys
            for _, raw, _ in batches._keys_by_bucket(key.key, key.doc, 1)
        ]
    names = ["shard", "groups", "least", "sizes", "data", "parts"]
    sent = [{**dict(zip(names, s)), "batch": r["batch"]} for r in rows for s in exact_substrings._batch_shards(r, 1, 1, 50, 24)]
    table = pa.Table.from_pylist(sent)
    assert np.frombuffer(sent[0]["parts"], "<i4").astype(bool).sum() > 10
    whole = exact_substrings._answers_of(table, 50, 1 << 40)
    assert whole.num_rows and whole.equals(exact_substrings._answers_of(table, 50, 1))
    assert whole.equals(exact_substrings._answers_of(table, 50, 5000))
