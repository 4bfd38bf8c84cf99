"""The kept-up index against one built anew."""

from __future__ import annotations

import random

import pytest

from parlova.operators import retrieval
from parlova.operators.segments import SEGMENT, TOMBSTONE, SegmentedIndex

SCHEMA = "doc_id bigint, customer_text string, support_reply string, intent string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, f"reply {i}", None) for i, t in docs.items()], SCHEMA)


def ids(spark, some):
    return spark.createDataFrame([(i,) for i in some], "doc_id bigint")


def content(index):
    """All tables of an index as sets of rounded rows."""
    tables = {
        "corpus": index.corpus.select("doc_id", "customer_text", "support_reply"),
        "lengths": index.doc_stats,
        "idf": index.term_idf,
        "lexical": index.lexical,
        "vocabulary": index.vocabulary.terms,
        "semantic": index.semantic,
    }
    out = {}
    for name, rows in tables.items():
        found = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows.select(*sorted(rows.columns)).collect()]
        assert len(found) == len(set(found)), name
        out[name] = set(found)
    return out


def text(rng):
    return " ".join(rng.choice(["order", "late", "refund", "card", "é", "a1", "shop", "help"]) for _ in range(rng.choice([0, 1, 4, 9])))


@pytest.mark.parametrize("seed", [1, 2])
def test_appends_deletes_and_compactions_equal_a_rebuild(spark, tmp_path, seed):
    rng = random.Random(seed)
    index = SegmentedIndex.create(spark, str(tmp_path / "index"))
    live = {}
    first = {i: text(rng) for i in range(30)}
    index.append(frame(spark, first))
    live |= first
    again = {i: text(rng) for i in [*range(25, 45)]}
    index.append(frame(spark, again))
    live |= again
    gone = [0, 1, 2, 26, 40, 999, 999, None]
    index.delete(ids(spark, gone))
    live = {i: t for i, t in live.items() if i not in gone}
    back = {1: "order refund order", 60: text(rng)}
    index.append(frame(spark, back))
    live |= back
    # Only the newest two parts fit; the older ones keep a tombstone of their own.
    index.compact(max_docs=25 if seed == 1 else None)
    assert sum(p.kind == SEGMENT for p in index.parts) == (2 if seed == 1 else 1)
    index.delete(ids(spark, [60, 3]))
    live = {i: t for i, t in live.items() if i not in (60, 3)}
    reopened = SegmentedIndex(spark, str(tmp_path / "index"))
    assert reopened.parts == index.parts and reopened.version == index.version
    assert content(reopened.index(12)) == content(retrieval.build_index(frame(spark, live), 12))


def test_small_cases(spark, tmp_path):
    index = SegmentedIndex.create(spark, str(tmp_path / "index"))
    assert index.parts == [] and index.corpus().count() == 0
    with pytest.raises(ValueError):
        index.index()
    index.delete(ids(spark, [1]))
    index.append(frame(spark, {}))
    index.append(spark.createDataFrame([(None, "a b", "r", None), (1, None, "r", None), (2, "a b", None, None)], SCHEMA))
    assert index.version == 0
    index.append(frame(spark, {1: "order late", 2: ""}))
    index.delete(ids(spark, [7]))
    index.compact()
    assert index.version == 1 and [p.kind for p in index.parts] == [SEGMENT]
    index.delete(ids(spark, [1, 2]))
    assert [p.kind for p in index.parts] == [SEGMENT, TOMBSTONE]
    _, n_docs, length = index.statistics()
    assert (n_docs, length) == (0, 0) and index.statistics()[0].count() == 0
    assert retrieval.hybrid_topk(spark.createDataFrame([(1, "order")], "qid bigint, text string"), index.index(), 2).count() == 0
