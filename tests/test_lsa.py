"""The distributed decomposition against numpy's."""

from __future__ import annotations

import random

import numpy as np

from parlova.operators import lsa, retrieval

SCHEMA = "doc_id bigint, customer_text string, support_reply string, intent string"


def corpus_of(spark, texts):
    return spark.createDataFrame([(i, t, "r", None) for i, t in enumerate(texts)], SCHEMA)


def topics(n, seed):
    rng = random.Random(seed)
    words = [["card", "charged", "refund", "money"], ["late", "parcel", "track", "depot"], ["login", "password", "reset", "mail"]]
    return [" ".join(rng.choices(words[i % 3], k=6) + rng.choices(["the", "please", "hello"], k=2)) for i in range(n)]


def test_components_match_numpy(spark):
    corpus = corpus_of(spark, [*topics(90, 1), "", "zzz"])
    vocabulary, weights = retrieval.semantic_index(corpus, 60)
    weights = weights.withColumnRenamed("feature", "gram")
    model = lsa.fit_lsa(weights, vocabulary, 6, 12)
    place = {g: i for i, g in enumerate(model.grams)}
    a = np.zeros((92, len(place)))
    for r in weights.collect():
        a[r.doc_id, place[r.gram]] = r.w
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.singular, s[:6], rtol=1e-3)
    assert np.allclose(np.abs(np.sum(model.components[:, :3] * vt[:3].T, axis=0)), 1, atol=1e-3)
    assert np.allclose(model.components.T @ model.components, np.eye(6), atol=1e-9)
    assert all(c[np.round(np.abs(c), 9).argmax()] > 0 for c in model.components.T)
    got = {r.doc_id: r.vec for r in lsa.lsa_vectors(weights, model).collect()}
    assert set(got) == {i for i in range(92) if a[i].any()}
    assert all(np.allclose(v, a[i] @ model.components) for i, v in got.items())
    # The same on any partitioning.
    again = lsa.fit_lsa(weights.repartition(5), vocabulary, 6, 12)
    assert np.allclose(again.components, model.components, atol=1e-6)


def test_texts_of_one_topic_lie_together(spark):
    corpus = corpus_of(spark, topics(60, 2))
    vocabulary, weights = retrieval.semantic_index(corpus)
    model = lsa.fit_lsa(weights.withColumnRenamed("feature", "gram"), vocabulary, 3)
    asked = spark.createDataFrame([(1, "refund money"), (2, "password reset"), (3, "unknown"), (4, None)], "qid bigint, text string")
    got = {r.qid: np.array(r.vec) for r in lsa.text_vectors(asked, model).collect()}
    assert set(got) == {1, 2, 3, 4} and not got[3].any() and not got[4].any()
    docs = {r.doc_id: np.array(r.vec) for r in lsa.lsa_vectors(weights.withColumnRenamed("feature", "gram"), model).collect()}
    for qid, topic in ((1, 0), (2, 2)):
        nearest = sorted(docs, key=lambda d: -docs[d] @ got[qid] / np.linalg.norm(docs[d]))[:15]
        assert all(d % 3 == topic for d in nearest)


def test_without_texts(spark):
    vocabulary, weights = retrieval.semantic_index(corpus_of(spark, [""]))
    model = lsa.fit_lsa(weights.withColumnRenamed("feature", "gram"), vocabulary)
    assert model.grams == [] and model.components.size == 0
