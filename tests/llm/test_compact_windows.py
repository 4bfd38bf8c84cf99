from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from parlova.llm import batches
from parlova.llm.batches import sliding_min
from parlova.llm import compact_windows as windows
from parlova.llm.compact_windows import PASSAGE_WORDS, Signatures, passage_classes, passage_links, tokens_of

from llm import reference


def shingles(found, start):
    return {tuple(found[i : i + 5]) for i in range(start, start + PASSAGE_WORDS - 4)}


def classes(texts, least):
    """Smallest index reachable over pairs with passages of at least ``least`` similarity."""
    sets = []
    for t in texts:
        found = [w.lower() for w in reference.words(t)]
        sets.append([shingles(found, s) for s in range(len(found) - PASSAGE_WORDS + 1)])

    def linked(i, j):
        return any(len(a & b) >= least * len(a | b) for a in sets[i] for b in sets[j])

    return reference.components(list(range(len(texts))), linked)


def corpus(seed):
    rng = random.Random(seed)

    def prose(n):
        return [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(n)]

    passages = [prose(rng.choice([51, 55, 60, 90])) for _ in range(6)]
    line = prose(10)
    texts = []
    for i in range(24):
        parts = prose(rng.randint(0, 60))
        if rng.random() < 0.6:
            passage = list(rng.choice(passages))
            if rng.random() < 0.3:
                passage[rng.randrange(len(passage))] = "changed"
            parts += passage
        parts += line + prose(rng.randint(0, 50))
        texts.append(" ".join(parts))
    return texts + [texts[0], texts[1], "", "short text", texts[2].upper()]


@pytest.mark.parametrize("options", [{}, {"batch_bytes": 2000, "hot_docs": 5}])
def test_classes_lie_between_equal_and_similar_passages(spark, options):
    texts = corpus(1)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, class_id int")
    got = {r.doc_id: r.class_id for r in passage_classes(docs, **options).collect()}
    assert sorted(got) == list(range(len(texts)))
    equal, similar = classes(texts, 1.0), classes(texts, 0.8)
    for i in range(len(texts)):
        assert got[i] == got[equal[i]], "equal passages must meet"
        assert similar[i] == similar[got[i]], "linked rows must be similar"
    assert len(set(got.values())) < len(texts)


def test_near_copies_are_found(spark):
    rng = random.Random(9)
    found = 0
    rows = []
    for k in range(40):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
        near = list(base)
        near[60] = "other"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in passage_classes(docs).collect()}
    found = sum(got[2 * k + 1] == 2 * k for k in range(40))
    assert found == 40 and all(got[2 * k] == 2 * k for k in range(40))


def test_odd_rows(spark):
    text = " ".join(f"v{i}" for i in range(80))
    rows = [(None, text), (None, text), (3, text), (3, text), (5, text + " x"), (6, None), (7, ""), (8, "a " * 200), (9, "a " * 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.class_id)) for r in passage_classes(docs).collect())
    assert got == sorted([("None", "None"), ("None", "None"), ("3", "3"), ("3", "3"), ("5", "3"), ("6", "6"), ("7", "7"), ("8", "8"), ("9", "8")])
    assert passage_classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    links = passage_links(docs).collect()
    assert all(r.a < r.b and r.similarity >= 0.8 for r in links)


def test_compact_windows_are_the_cartesian_nodes_that_span_a_passage():
    rng = random.Random(4)
    text = " ".join(f"w{rng.randint(0, 60)}" for _ in range(400)).encode()
    tokens = tokens_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    place, value = Signatures(tokens).minima(0)
    from parlova.llm import compact_windows as c

    h = [int(x) >> 32 for x in c.mixed(tokens.hash ^ c._SEEDS[0])]

    def nodes(low, high):
        if high - low < c.TOKENS:
            return set()
        at = min(range(low, high), key=lambda i: (h[i], i))
        return {at} | nodes(low, at) | nodes(at + 1, high)

    assert set(place.tolist()) == nodes(0, len(h))
    assert sliding_min(np.array([3, 1, 2, 5, 4]), 3).tolist() == [1, 1, 2]


def near_pairs(seed, n, change):
    """Rows 2 k and 2 k + 1 hold a 50-word passage and its changed copy in different texts."""
    rng = random.Random(seed)

    def prose(k):
        return [f"w{rng.randint(0, 10**6)}" for _ in range(k)]

    rows = []
    for k in range(n):
        base = prose(PASSAGE_WORDS)
        rows.append((2 * k, " ".join(prose(30) + base + prose(30))))
        rows.append((2 * k + 1, " ".join(prose(30) + change(list(base)) + prose(30))))
    return rows


def changed_word(passage):
    passage[25] = "other"
    return passage


def test_hot_keys_lose_no_near_copies(spark):
    docs = spark.createDataFrame(near_pairs(21, 60, changed_word), "doc_id bigint, text string")
    cold = {r.doc_id: r.class_id for r in passage_classes(docs).collect()}
    hot = {r.doc_id: r.class_id for r in passage_classes(docs, hot_docs=1).collect()}
    assert hot == cold
    assert sum(cold[2 * k + 1] == 2 * k for k in range(60)) >= 50


def runs_of(rows):
    """All runs of the rows, as a shard would see them."""
    data = [t.encode() for _, t in rows]
    tokens = tokens_of(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data]))
    signatures = Signatures(tokens)
    columns = {n: [] for n in windows._PARTS}
    for band in range(windows.BANDS):
        r = signatures.runs(band)
        size = r.last - r.first + windows.TOKENS
        flat = (tokens.hash >> np.uint64(48))[windows._expand(r.first, size)]
        values = (r.key, tokens.text[r.first], r.first, r.centre - r.first, size, flat)
        for (n, column), v, t in zip(columns.items(), values, windows._TYPES):
            column.append(v.astype(t).tobytes())
    return windows._Passages(pa.table({n: pa.array(c, pa.binary()) for n, c in columns.items()}))


def same_key_pairs(p):
    i, j = np.triu_indices(len(p.key), 1)
    return [(a, b) for a, b in zip(i, j) if p.key[a] == p.key[b] and p.doc[a] // 2 == p.doc[b] // 2 and p.doc[a] != p.doc[b]]


def as_sets(p, run):
    found = p.flat[p.bounds[run] : p.bounds[run] + p.size[run]].tolist()
    return [set(found[i : i + windows.TOKENS]) for i in range(len(found) - windows.TOKENS + 1)]


@pytest.mark.parametrize(
    "change, similar",
    [(lambda p: p[:20] + ["new"] + p[20:], True), (lambda p: p[:30] + p[31:], True), (lambda p: p[:8] * 3 + p[:30] * 2, False)],
)
def test_similarity_is_the_largest_over_all_passages_of_two_runs(change, similar):
    linked = 0
    for k in range(6):
        p = runs_of(near_pairs(60 + k, 1, change))
        found = same_key_pairs(p)
        if not found:
            continue
        a, b = (np.array(x) for x in zip(*found))
        for i, j, got in zip(a, b, p.similarity(a, b)):
            want = max(len(x & y) / len(x | y) for x in as_sets(p, i) for y in as_sets(p, j))
            assert (got >= 0.8) == (want >= 0.8)
            linked += want >= 0.8
    assert linked or not similar


def test_runs_of_a_hot_key_are_dealt_over_shards():
    """One passage in 40 different texts: no shard gets all runs of a key, and equal passages meet."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(PASSAGE_WORDS)]
    texts = [[f"w{rng.randint(0, 10**6)}" for _ in range(20)] + passage + [f"w{rng.randint(0, 10**6)}" for _ in range(20)] for _ in range(40)]
    data = [" ".join(t).encode() for t in texts]
    row = {"ids": np.arange(40), "data": np.frombuffer(b"".join(data), np.uint8), "offsets": np.cumsum([0] + [len(d) for d in data]), "batch": 0}
    found = pa.table({n: list(c) for n, c in zip(("bucket", "keys", "more"), zip(*batches._keys_by_bucket(*windows.band_keys(row), 1)))})
    shared = batches._shared_of(found.append_column("batch", pa.array([0] * found.num_rows)), 10)
    row["shared"] = shared.to_pylist()
    sent = list(windows._batch_passages(row, 1, 8))
    shards = {}
    for shard, key, *_ in sent:
        if 0 <= shard < 16:
            for k in np.frombuffer(key, "<u8").tolist():
                shards.setdefault(k, []).append(shard)
    most = max(shards.values(), key=len)
    assert len(most) >= 20 and len(set(most)) > 3
    linked = {x for shard, a, b, *_ in sent if shard == -1 for x in zip(np.frombuffer(a, "<i8").tolist(), np.frombuffer(b, "<i8").tolist())}
    assert {(0, i) for i in range(1, 40)} <= linked


def test_hot_keys_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 2)
    rng = random.Random(3)
    base = [f"p{i}" for i in range(PASSAGE_WORDS + 10)]
    rows = []
    for i in range(24):
        passage = list(base)
        passage[8 * (i % 3)] = f"other{i % 6}"
        passage = passage[: 30 + (i % 2)] + base[30 + (i % 2) :] if i < 18 else base[:20] + [f"q{i}_{j}" for j in range(40)]
        rows.append((i, " ".join([f"w{rng.randint(0, 10**6)}" for _ in range(20)] + passage)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    cold = sorted(map(tuple, passage_classes(docs).collect()))
    assert cold == sorted(map(tuple, passage_classes(docs, hot_docs=2).collect()))
    assert len({c for _, c in cold}) > 1


def test_dissimilar_runs_are_not_compared_place_by_place(monkeypatch):
    """Runs that share too few shingles end at their sketches; the others keep the value of all passages as sets."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 60_000, (20, 60))
    runs = []
    for i in range(60):
        own = np.roll(base[i % 20], i // 20)
        own[: 3 * (i // 20)] = rng.integers(0, 60_000, 3 * (i // 20))
        runs.append(own.astype("<u2"))
    n = len(runs)
    columns = [np.zeros(n), np.arange(n), np.zeros(n), np.full(n, 30), np.full(n, 60), np.concatenate(runs)]
    table = {c: pa.array([v.astype(t).tobytes()], pa.binary()) for c, v, t in zip(windows._PARTS, columns, windows._TYPES)}
    p = windows._Passages(pa.table(table))
    a, b = np.triu_indices(n, 1)
    compared = []
    plain = np.nonzero
    monkeypatch.setattr(np, "nonzero", lambda x: compared.append(len(x) if x.ndim == 3 else 0) or plain(x))
    got = p._sliding(a, b)
    sets = [as_sets(p, run) for run in range(n)]
    want = np.array([max(len(x & y) / len(x | y) for x in sets[i] for y in sets[j]) for i, j in zip(a, b)])
    want[want < windows.SIMILARITY] = 0
    assert np.allclose(got, want) and (got > 0).any()
    assert sum(compared) <= 3 * 20
