from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from parlova.llm import decontam


def normal(text):
    out = "".join(c.lower() if len(c.lower()) == 1 and ord(c) < 0x250 else c for c in text or "")
    for c in "\t\n\v\f\r":
        out = out.replace(c, " ")
    while "  " in out:
        out = out.replace("  ", " ")
    return out


def fewest_edits(item, text):
    """Fewest edits of item against any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def brute(docs, items, rate=decontam.EDIT_RATE):
    out = {}
    for i, t in docs:
        for k, item in items:
            p = normal((item or "").strip(" \t\n\v\f\r"))
            if p:
                edits = fewest_edits(p, normal(t))
                if edits <= int(len(p) * rate):
                    out[i, k] = edits
    return out


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id bigint, text string, item_id int, edits string"),
        spark.createDataFrame([(k, t, 1) for k, t in items], "item_id bigint, text string, doc_id int"),
    )


def planted(seed):
    rng = random.Random(seed)

    def prose(n):
        return "".join(rng.choice("abcdefgh  É\n") for _ in range(n))

    items = [(k, prose(n)) for k, n in enumerate([30, 60, 100, 150, 12, 5, 2])] + [(7, None), (8, ""), (9, "  "), (10, None)]
    items.append((11, items[2][1]))
    docs = []
    for i in range(25):
        text = prose(rng.randint(0, 120))
        if i % 5 < 3:
            item = rng.choice(items[:4])[1]
            if i % 5 > 0:
                chars = list(item)
                for _ in range(rng.randint(1, 5)):
                    at = rng.randrange(len(chars))
                    chars[at : at + 1] = rng.choice([[], ["z"], [chars[at], "y"]])
                item = "".join(chars)
            text += item.upper() if i % 2 else item
        docs.append((i, text + prose(rng.randint(0, 100))))
    docs += [(100, None), (101, ""), (102, " \n "), (103, "ab"), (104, items[0][1] * 30), (105, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("slice_chars", [1 << 20, 150])
def test_matches_brute_force(spark, seed, slice_chars):
    docs, items = planted(seed)
    found = decontam.contaminated(*tables(spark, docs, items), slice_chars=slice_chars).collect()
    assert {(r.doc_id, r.item_id): r.edits for r in found} == brute(docs, items)
    texts, wanted = dict(docs), dict(items)
    for r in found:
        part = normal(texts[r.doc_id][r.start : r.end])
        assert fewest_edits(normal(wanted[r.item_id].strip()), part) <= r.edits
    kept = decontam.drop_contaminated(*tables(spark, docs, items), slice_chars=slice_chars)
    assert kept.columns == ["doc_id", "text", "item_id", "edits"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(texts) - {i for i, _ in brute(docs, items)})


def test_empty_tables(spark):
    docs, items = tables(spark, [(1, "some text")], [(1, "some text")])
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs, items.limit(0)).count() == 1
    assert decontam.contaminated(docs, items).count() == 1


def test_the_lemma_holds_for_every_length():
    for n in range(1, 400):
        edits, q, bound = decontam.plan(n)
        assert 1 <= q <= n and bound >= 1 and bound <= n + 1 - q * (edits + 1) or q == 1


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(0)
    for _ in range(300):
        p = rng.integers(0, 3, rng.integers(1, 14)).astype(np.uint32)
        t = rng.integers(0, 3, rng.integers(0, 30)).astype(np.uint32)
        want = fewest_edits(p.tolist(), t.tolist())
        for edits in (0, 1, 3, 14):
            got = decontam.align(p, t, edits)
            assert (got is None) == (want > edits)
            if got:
                assert got[0] == want and fewest_edits(p.tolist(), t[got[1] : got[2]].tolist()) == want


@pytest.mark.parametrize("text", ["ΤΟ ΓΡΉΓΟΡΟ ΚΑΦΈ ΖΏΟ", "СЪЕШЬ ЕЩЁ ЭТИХ БУЛОК", "ԲԱՐԵՎ", "Ⅷ Ⓐ ＦＵＬＬ", "𐐀𐐁 DŽ ẞ"])
def test_letters_of_all_scripts_are_lower_cased(text):
    data = text.encode()
    points, _, _ = decontam.normal_points(decontam.Texts(slice(0, 1), np.frombuffer(data, np.uint8), np.array([0, len(data)])))
    assert "".join(map(chr, points)) == "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def test_steps_inside_a_text_change_nothing(monkeypatch):
    """Counts carried over steps give the matches of one step, with items that repeat themselves."""
    rng = np.random.default_rng(4)
    items = [(1, "ab" * 60), (2, "a" * 50), (3, "".join(rng.choice(list("abc "), 80))), (4, "ba" * 40 + "c")]
    texts = ["ab" * 400 + "x" * 30 + "ab" * 90, "a" * 300, "", "".join(rng.choice(list("abc "), 500)) + items[2][1], "ba" * 200 + "c" + "a" * 45, "zzz"]
    tables = decontam.prepare_items(items)
    piece = next(decontam.pieces(pa.array(texts)))
    want = sorted(decontam._matches(piece, tables))
    assert {f[0] for f in want} >= {0, 1, 3, 4}
    for step in (1, 7, 1000):
        monkeypatch.setattr(decontam, "STEP", step)
        assert sorted(decontam._matches(piece, tables)) == want


def test_a_long_text_of_one_gram_needs_bounded_memory():
    """Half as many occurrences again per step would show; a text of 100,000 has some 40 million."""
    points = np.frombuffer(("ab" * 50_000).encode("utf-32-le"), np.uint32)
    grams = decontam.prepare_items([(1, "ab" * 400)])[0]
    tracemalloc.start()
    found = sum(1 for _ in decontam._regions(points, np.array([0, len(points)]), grams))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 100 and peak < 250 << 20


def test_column_names_in_any_case(spark):
    docs = spark.createDataFrame([(1, "the benchmark text is in here", 5), (2, "clean", 6)], "doc_id bigint, Text string, last int")
    items = spark.createDataFrame([(1, "benchmark text is in")], "item_id bigint, text string")
    assert [tuple(r) for r in decontam.drop_contaminated(docs, items).collect()] == [(2, "clean", 6)]
    with pytest.raises(ValueError):
        decontam.drop_contaminated(docs, items, text_col="body")
