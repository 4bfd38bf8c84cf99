"""Classifiers, clusters and the whole triage on small tables."""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from parlova.functions import text as tx
from parlova.operators import classify, cluster, retrieval
from parlova.operators import triage as tr
from parlova.operators.vectors import with_encoder
from parlova.runtime import materialize, scratch_scope, shared_dir
from parlova.streaming.triage import read_triage_output, start_triage_stream

TEXTS = {
    "PAYMENT_ISSUE": ["my payment failed", "card was charged twice", "payment never went through"],
    "CANCELLATION": ["please cancel the plan", "cancel everything now", "want to cancel today"],
    "LOGIN_OR_ACCOUNT": ["cannot log in", "forgot the password", "account locked out"],
}


def _train(spark, copies=3):
    rows = [(t, label) for label, texts in TEXTS.items() for t in texts] * copies
    return spark.createDataFrame([(i, t, label) for i, (t, label) in enumerate(rows)], "doc_id bigint, text string, intent string")


def _ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid bigint, text string")


@pytest.fixture(scope="module")
def text_model(spark):
    return classify.train_text_classifier(_train(spark), max_iter=100)


def test_text_classifier(spark, text_model):
    rows = classify.with_intent(text_model.probabilities(_ask(spark, "payment failed again", "zzqx")), text_model.classes, 0.0).collect()
    for r in rows:
        assert r.intent in TEXTS and 0.0 <= r.confidence <= 1.0 and len(r.top_intents) == 3
        assert math.isclose(sum(r.probs), 1.0)
    assert {r.qid: r.intent for r in rows}[0] == "PAYMENT_ISSUE"


def test_low_confidence_becomes_other(spark, text_model):
    r = classify.with_intent(text_model.probabilities(_ask(spark, "zzqx")), text_model.classes, 0.99).first()
    assert r.intent == "OTHER_OR_UNKNOWN" and r.top_intents[0].intent in TEXTS


@pytest.mark.parametrize("confidence,want", [(0.6, "a"), (0.5999, "OTHER_OR_UNKNOWN")])
def test_gate_at_the_threshold(spark, confidence, want):
    df = spark.createDataFrame([([confidence, 1 - confidence],)], "probs array<double>")
    assert classify.with_intent(df, ["a", "b"], 0.6).first().intent == want


def test_text_classifier_survives_storage(spark, text_model, tmp_path):
    text_model.save(str(tmp_path / "m"))
    loaded = classify.load_text_classifier(spark, str(tmp_path / "m"))
    ask = _ask(spark, "cancel my card")
    assert loaded.classes == text_model.classes
    assert np.allclose(loaded.probabilities(ask).first().probs, text_model.probabilities(ask).first().probs)


def test_centroid_model_prefers_the_matching_class(spark):
    model = classify.centroid_model(_train(spark))
    scored = classify.with_intent(classify.linear_probabilities(_ask(spark, "please cancel", ""), model), model.classes, 0.0)
    rows = {r.qid: r for r in scored.collect()}
    assert rows[0].intent == "CANCELLATION"
    assert np.allclose(rows[1].probs, 1 / 3)


def test_sigmoid_fit_reaches_the_optimum(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(size=400)
    y = rng.random(400) < 1 / (1 + np.exp(-(2.0 * f - 0.5)))
    df = spark.createDataFrame([(0, 0, float(a), bool(b)) for a, b in zip(f, y)], "fold int, class_no int, f double, positive boolean")
    r = classify.fit_sigmoids(df).first()
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    d = t - 1 / (1 + np.exp(r.a * f + r.b))
    assert abs(d.sum()) < 1e-5 and abs((d * f).sum()) < 1e-5 and r.a < 0


def test_folds_are_balanced_within_classes(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 9, "rare").otherwise("big").alias("intent"))
    counts = {(r.intent, r.fold): r["count"] for r in classify.stratified_folds(df, "intent", "doc_id").groupBy("intent", "fold").count().collect()}
    assert {k: v for k, v in counts.items() if k[0] == "rare"} == {("rare", i): 3 for i in range(3)}
    assert [counts["big", i] for i in range(3)] == [97, 97, 97]


def test_calibrated_classifier(spark, tmp_path):
    model = classify.train_calibrated(_train(spark, 4), max_iter=100)
    assert isinstance(model, classify.CalibratedClassifier) and len(model.models) == 3
    ask = _ask(spark, "payment failed", "forgot password", "please cancel")
    rows = classify.with_intent(model.probabilities(ask), model.classes, 0.0).collect()
    assert {r.qid: r.intent for r in rows} == {0: "PAYMENT_ISSUE", 1: "LOGIN_OR_ACCOUNT", 2: "CANCELLATION"}
    assert all(math.isclose(sum(r.probs), 1.0) for r in rows)
    model.save(str(tmp_path / "c"))
    loaded = classify.load_calibrated_classifier(spark, str(tmp_path / "c"), with_features=True)
    again = {r.qid: r.probs for r in loaded.probabilities(ask).collect()}
    assert all(np.allclose(again[r.qid], r.probs) for r in rows)


def test_calibration_needs_three_rows_per_class(spark):
    small = _train(spark, 1).where("doc_id <> 0 and doc_id <> 1")
    assert isinstance(classify.train_calibrated(small, max_iter=50), classify.TextClassifier)


def test_calibrated_classifier_on_vectors(spark):
    rng = np.random.default_rng(2)
    centers = {"a": [3.0, 0.0], "b": [0.0, 3.0], "c": [-3.0, -3.0]}
    rows = [(i * 3 + j, (np.array(c) + rng.normal(size=2)).tolist(), n) for i in range(30) for j, (n, c) in enumerate(centers.items())]
    df = spark.createDataFrame(rows, "doc_id bigint, vec array<double>, intent string").withColumn("features", array_to_vector("vec"))
    model = classify.train_calibrated(df, max_iter=50)
    scored = classify.with_intent(model.probabilities(df.withColumnRenamed("doc_id", "qid").drop("intent")), model.classes, 0.0)
    wrong = scored.join(df.select(F.col("doc_id").alias("qid"), F.col("intent").alias("y")), "qid").where("intent <> y").count()
    assert wrong <= 3


# --- clusters ---------------------------------------------------------------------


def _blobs(spark, n=40):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=3) * 0.3 + (5.0 if i % 4 else -5.0)).tolist(), int(i % 4 > 0)) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id bigint, vec array<double>, label int")


def _silhouette(vec, label):
    dist = np.linalg.norm(vec[:, None] - vec[None], axis=2)
    out = []
    for i in range(len(vec)):
        own = (label == label[i]) & (np.arange(len(vec)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a = dist[i, own].mean()
        b = min(dist[i, label == c].mean() for c in set(label) - {label[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


@pytest.mark.parametrize("block", [7, 1000])
def test_silhouette_in_blocks(spark, block):
    df = _blobs(spark).withColumn("label", F.when(F.col("vec_id") == 5, 7).otherwise(F.col("label")))
    pdf = df.toPandas()
    want = _silhouette(np.stack(pdf["vec"]), pdf["label"].to_numpy())
    assert math.isclose(cluster.silhouette_exact(df, "label", block).first()[0], want, abs_tol=1e-9)


def test_silhouette_of_one_cluster_is_zero(spark):
    one = _blobs(spark).withColumn("label", F.lit(0))
    assert cluster.silhouette_exact(one, "label").first()[0] == 0.0
    assert cluster.silhouette_fast(one, "label").first()[0] == 0.0


def test_kmeans_finds_the_blobs(spark):
    rows = _blobs(spark)
    fit = cluster.fit_kmeans(rows, 2, n_init=3)
    pairs = cluster.assign_kmeans(rows, fit).groupBy("label", "cluster").count().collect()
    assert len(pairs) == 2 and cluster.cluster_count(7) == 2 and cluster.cluster_count(1000) == 8


def test_text_clusters(spark):
    docs = _train(spark, 4).select(F.col("doc_id").alias("vec_id"), "text")
    found = cluster.discover_text_clusters(docs, 3, n_init=4, n_examples=2)
    rows = found.assigned.toPandas()
    assert len(rows) == 36 and rows["cluster"].nunique() == 3
    reps = found.representatives.toPandas()
    assert reps.groupby("cluster").size().max() == 2
    # Equal texts stay together, and the score matches a plain calculation.
    assert (rows.groupby("text")["cluster"].nunique() == 1).all()
    features = classify.fit_text_features(docs.withColumn("grams", tx.ngrams(F.col("text"))), 5000, 2)
    dense = features.transform(docs.withColumn("grams", tx.ngrams(F.col("text")))).select("vec_id", vector_to_array("features").alias("v")).toPandas()
    both = rows.merge(dense, on="vec_id")
    want = _silhouette(np.stack(both["v"]), both["cluster"].to_numpy())
    assert math.isclose(found.silhouette.first()[0], want, abs_tol=1e-7)


def test_own_encoder_runs_in_batches(spark):
    docs = _ask(spark, "abc", "a", None)
    out = with_encoder(docs, "text", lambda: lambda texts: [[len(t), 1.0] for t in texts])
    assert {r.qid: list(r.vec) for r in out.collect()} == {0: [3.0, 1.0], 1: [1.0, 1.0], 2: [0.0, 1.0]}


# --- triage ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def index(spark):
    corpus = _train(spark, 1).select("doc_id", F.col("text").alias("customer_text"), F.concat(F.lit("handled: "), "text").alias("support_reply"), "intent")
    return retrieval.build_index(corpus)


def _messages(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid bigint, message string")


def test_triage_gives_a_valid_response(spark, text_model, index):
    config = tr.TriageConfig(confidence_threshold=0.0, min_grounding_score=0.0)
    rows = tr.triage(_messages(spark, "my payment failed again", "", None), text_model.probabilities, text_model.classes, index, config)
    got = {r.qid: r for r in rows.collect()}
    assert set(got) == {0, 1, 2}
    assert got[0].intent == "PAYMENT_ISSUE" and got[0].decision in {"AUTO_HANDLE", "ESCALATE"} and got[0].draft_reply
    assert len(got[0].retrieved_examples) == 5 and got[0].retrieved_examples[0].intent_match is True
    v = tr.response_violations(rows).first()
    assert (v.n_rows, v.n_bad_confidence, v.n_missing_reply, v.n_bad_decision) == (3, 0, 0, 0)


def test_triage_without_evidence_escalates(spark, text_model, index):
    config = tr.TriageConfig(confidence_threshold=0.0, min_grounding_score=0.99)
    r = tr.triage(_messages(spark, "weather talk"), text_model.probabilities, text_model.classes, index, config).first()
    assert r.decision == "ESCALATE" and r.reason_code in {"NO_RELEVANT_HISTORY", "CONFLICTING_HISTORY"}
    assert r.generation_mode == "fallback_no_evidence"


def test_triage_uses_usable_model_answers_only(spark, text_model, index):
    answers = spark.createDataFrame(
        [(0, '{"reply": "from the model", "grounded": true}'), (1, '{"reply": ""}'), (2, '{"reply": "x", "grounded": false}')], "qid bigint, raw_response string"
    )
    config = tr.TriageConfig(confidence_threshold=0.0, min_grounding_score=0.0)
    rows = tr.triage(_messages(spark, *["my payment failed"] * 4), text_model.probabilities, text_model.classes, index, config, answers)
    got = {r.qid: (r.generation_mode, r.reason_code) for r in rows.collect()}
    assert got[0][0] == "llm" and got[1][0] == got[3][0] == "fallback_retrieval"
    assert got[2][0] == "llm" and got[2][1] in {"UNSUPPORTED_INFORMATION", "CONFLICTING_HISTORY"}


def test_stream_equals_batch_and_repeats_no_batch(spark, text_model, index, tmp_path):
    messages = _messages(spark, "my payment failed", "cancel it", "forgot my password", "hello")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    messages.repartition(3).write.parquet(source)
    for _ in range(2):
        start_triage_stream(spark, source, out, state, text_model.probabilities, text_model.classes, index, files_per_batch=1).awaitTermination()
    streamed = {r.qid: (r.intent, r.decision, r.draft_reply) for r in read_triage_output(spark, out).collect()}
    batch = tr.triage(messages, text_model.probabilities, text_model.classes, index)
    assert read_triage_output(spark, out).count() == 4
    before = set(Path(shared_dir(spark)).glob("table-*"))
    with scratch_scope(spark):
        made = materialize(spark.range(5)).count()
    assert made == 5 and set(Path(shared_dir(spark)).glob("table-*")) == before
    assert streamed == {r.qid: (r.intent, r.decision, r.draft_reply) for r in batch.collect()}


def test_silhouette_of_sparse_rows_sends_a_point_as_often_in_any_table(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vec = rng.random((90, 12)) * (rng.random((90, 12)) < 0.3)
    label = rng.integers(0, 4, 90)
    rows = [(i, int(c), v[v > 0].tolist(), np.flatnonzero(v).tolist()) for i, (v, c) in enumerate(zip(vec, label))]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, vec array<double>, idx array<int>")
    blocks = []
    plain = cluster.triangle_apply
    monkeypatch.setattr(cluster, "triangle_apply", lambda *a: blocks.append(a[2]) or plain(*a))
    for block in (1, 1000):
        assert math.isclose(cluster.silhouette_exact(df, "label", block).first()[0], _silhouette(vec, label), abs_tol=1e-9)
    assert blocks == [cluster.SILHOUETTE_BLOCKS, 1]


def test_texts_are_dealt_by_their_length(spark, monkeypatch):
    from parlova.operators import vectors

    monkeypatch.setattr(vectors, "TASK_CHARS", 100, raising=False)
    docs = spark.createDataFrame([(i, "some words here " * 4) for i in range(20)], "doc_id bigint, text string")
    counts = vectors.gram_counts(docs)
    assert counts.rdd.getNumPartitions() == 1 + 20 * 64 // 100
    assert sorted({(r.gram, r.tf) for r in counts.collect()})[:2] == [("here", 4), ("here some", 3)]
    assert counts.count() == 20 * 6
