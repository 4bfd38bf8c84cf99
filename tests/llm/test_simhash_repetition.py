from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from parlova.llm.arrays import pieces, words
from parlova.llm.components import connected_components
from parlova.llm.repetition import judge, keep_good, repetition_stats
from parlova.llm.simhash import anchor_rows, keep_first, near_duplicates

from llm import reference

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " \n\t ", "one", "One TWO", "a a a a a", "x\ny\nx\n\nx", "é ü ß\vß é\fü", " lead and trail \r\n",
    "same line here\n" * 40, "word " * 300, "A*b #c <d> 100% & $5|", "\n\n\n", "x" * 5000,
]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], "doc_id bigint, text string, fp string, root int")


def test_words_and_pieces():
    column = pa.array(ODD)
    got = []
    for texts in pieces(column, 64):
        found = words(texts)
        raw = texts.data.tobytes()
        own = [[] for _ in range(len(texts))]
        for s, e, t in zip(found.start, found.end, found.text):
            own[t].append(raw[s:e].decode())
        got += own
    assert got == [reference.words(t) for t in ODD]


def test_fingerprints_and_components_match_brute_force(spark):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = list(ODD)
    for _ in range(25):
        base = [random.choice(vocabulary) for _ in range(random.randint(3, 120))]
        texts.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            near[random.randrange(len(near))] = random.choice(vocabulary)
            texts.append("  ".join(near).upper())
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(rows_of(spark, texts)).collect()}
    fps = [reference.fingerprint(t) for t in texts]
    want = reference.components(list(range(len(texts))), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(texts))}


def test_every_pair_within_three_bits_meets_at_a_home_anchor():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 300).astype(np.uint64)
    for bits in (1, 2, 3):
        other = fp.copy()
        for _ in range(bits):
            other ^= np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)
        ka, fa, ha = anchor_rows(fp)
        kb, fb, _ = anchor_rows(other)
        homes = {}
        for k, f, h in zip(ka.tolist(), fa.tolist(), ha.tolist()):
            if h:
                homes.setdefault(k, set()).add(f)
        met = set()
        for k, f in zip(kb.tolist(), fb.tolist()):
            met |= {(x, f) for x in homes.get(k, ())}
        assert all((a, b) in met for a, b in zip(fp.tolist(), other.tolist()))


def test_keep_first_keeps_one_of_each_group_and_all_columns(spark):
    docs = rows_of(spark, ["same words in here", "other text of mine", "same words in here", None, ""])
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3]


def test_keep_first_with_clashing_names(spark):
    rows = [(1, "one two three", 5), (2, "one two three", 1), (3, "quite another text", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, Text string, _LOST int")
    assert sorted(map(tuple, keep_first(docs).collect())) == [rows[0], rows[2]]


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates(empty).count() == 0
    assert repetition_stats(empty).count() == 0
    assert keep_good(empty).count() == 0 and keep_first(empty).count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "q r s t u v"), (7, "a b c d"), (7, "a b c d")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in near_duplicates(docs).collect())
    assert got == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert keep_first(docs).count() == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_repetition_matches_brute_force(spark, seed):
    random.seed(seed)
    texts = list(ODD)
    for _ in range(40):
        n = random.randint(1, 90)
        base = [random.choice("abcdefgh") for _ in range(n)]
        if random.random() < 0.5:
            at = random.randrange(n)
            base = base + base[at : at + 30] + base[: random.randint(0, 20)]
        texts.append(random.choice([" ", "\n", " \n"]).join(base))
    got = {r.doc_id: r.asDict() for r in repetition_stats(rows_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == {"doc_id": i, **reference.repetition(t)}, repr(t)


def test_verdict_and_filter(spark):
    fine = " ".join(f"word{i}" for i in range(120))
    long_copy = " ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"w{i}" for i in range(60))
    docs = rows_of(spark, [fine, "too short", long_copy, None, fine])
    marks = {r.doc_id: (r.base_failed, r.kept) for r in judge(repetition_stats(docs)).collect()}
    assert marks == {0: (False, True), 1: (True, False), 2: (True, False), 3: (True, False), 4: (False, True)}
    kept = keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 4]


def test_repeats_whose_suffix_order_neighbours_begin_differently(spark):
    texts = ["h g g g g b", "a h g g g g b", "x y y y y z y y y q"]
    got = {r.doc_id: r.asDict() for r in repetition_stats(rows_of(spark, texts)).collect()}
    assert [got[i]["n_repeat_words"] for i in range(3)] == [4, 4, 7]
    for i, t in enumerate(texts):
        assert got[i] == {"doc_id": i, **reference.repetition(t)}, repr(t)
