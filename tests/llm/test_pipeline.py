from __future__ import annotations

import random

import corpus_pipeline
from parlova.runtime import materialize

from llm import reference
from llm.test_decontam import brute
from llm.test_pii import plain


def rows(seed=3):
    rng = random.Random(seed)

    def prose(n):
        return " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 3000)}" for _ in range(n))

    items = [(k, prose(30)) for k in range(4)]
    texts = [prose(rng.randint(55, 90)) for _ in range(25)]
    texts += [texts[0], texts[1] + " tail", prose(20), None, "", "spam eggs " * 60]
    texts += [prose(40) + " " + items[2][1] + " " + prose(20), prose(60) + " a@b.example.com and 4111 1111 1111 1111"]
    docs = [(i, t, "en", f"src{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    return docs, items


def tables(spark, docs, items, path):
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_follow_each_other(spark, tmp_path):
    docs, items = rows()
    sf_dir = tables(spark, docs, items, tmp_path)
    # Plain versions of the first three stages.
    texts = {i: t for i, t, *_ in docs}
    good = []
    for i, t in texts.items():
        m = reference.repetition(t)
        n = m["n_words"]
        if n >= 50 and 100 * m["n_repeat_words"] <= 50 * n and m["n_covered_words"] <= 0.2 * n and m["longest_repeat"] <= max(0.2 * n, 10):
            good.append(i)
    fps = [reference.fingerprint(texts[i]) for i in good]
    parts = reference.components(good, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    first = [i for i, p in zip(good, parts) if i == p]
    dirty = {i for i, _ in brute([(i, texts[i]) for i in first], items)}
    want = [good, first, [i for i in first if i not in dirty]]
    assert len(want[0]) < len(docs) and len(want[1]) < len(want[0]) and len(want[2]) < len(want[1])

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = table.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        table = materialize(stage(spark, table, sf_dir))
        if k < 4:
            assert table.columns == columns, name
        if k < 3:
            assert sorted(r.doc_id for r in table.collect()) == want[k], name
        if k == 3:
            left = {r.doc_id: r for r in table.collect()}
            assert sorted(left) == want[2]
            assert all(not plain(r.text) and r.n_chars == len(r.text) for r in left.values())
            assert left[max(left)].text.endswith(" [EMAIL] and [CARD]")
    got = table.collect()
    assert sorted(r.doc_id for r in got) == want[2] and sum(r.taken for r in got) > 0
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.taken) for r in whole.collect()) == sorted((r.doc_id, r.taken) for r in got)


def test_empty_documents(spark, tmp_path):
    sf_dir = tables(spark, [], [(1, "some benchmark text")], tmp_path)
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
