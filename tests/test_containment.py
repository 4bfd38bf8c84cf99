from __future__ import annotations

import random

from parlova.operators import leakage


def test_contained_items_match_plain_search(spark):
    rng = random.Random(9)
    vocabulary = ["a", "b", "C", "d", "é", "f"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 9, 14]))) for i in range(30)] + [(30, ""), (31, None), (32, " \n "), (None, "a b"), (33, "A  b\tc")]
    docs = [(i, text(rng.choice([0, 1, 6, 40]))) for i in range(60)]
    docs += [(100 + i, f"{text(5)} {(t or '').upper()}\n{text(5)}") for i, (_, t) in enumerate(items)]
    docs += [(200, None), (None, "a b c d"), (201, "a " * 3000), docs[5], (5, "a b c d e f")]

    def words(t):
        return (t or "").lower().split()

    def holds(d, i):
        d, i = words(d), words(i)
        return bool(i) and any(d[k : k + len(i)] == i for k in range(len(d) - len(i) + 1))

    want = {(i, d) for i, t in items for d, u in docs if i is not None and d is not None and holds(u, t)}
    q = spark.createDataFrame(items, "item_id bigint, text string")
    rows = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, n int")
    for width in (8, 3):
        got = [tuple(r) for r in leakage.contained_items(q, rows, width).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert leakage.contained_items(q.limit(0), rows).collect() == []
    assert leakage.contained_items(q, rows.limit(0)).collect() == []
