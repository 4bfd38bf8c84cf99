"""Unknown signals, odd inputs, hot keys and pending states."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from parlova.functions.ids import parse_created_at
from parlova.operators import agreement, classify, evaluate, leakage, policy, retrieval, sampling, similarity, skew, threads, triage
from parlova.schemas import TWEET_COLUMNS, SchemaError
from parlova.sources.intents import read_intent_config
from parlova.sources.tweets import normalize_tweets, read_tweets_csv

NAN = float("nan")


@pytest.mark.parametrize(
    "change, code",
    [
        ({}, None),
        ({"intent": None}, "UNKNOWN_INTENT"),
        ({"confidence": None}, "LOW_INTENT_CONFIDENCE"),
        ({"confidence": NAN}, "LOW_INTENT_CONFIDENCE"),
        ({"top": None}, "NO_RELEVANT_HISTORY"),
        ({"top": NAN}, "NO_RELEVANT_HISTORY"),
        ({"grounded": None}, "UNSUPPORTED_INFORMATION"),
        ({"message": None}, None),
    ],
)
def test_unknown_signals_escalate(spark, change, code):
    row = {"message": "where is it", "intent": "REFUND_REQUEST", "confidence": 0.9, "top": 0.9, "grounded": True} | change
    kinds = "message string, intent string, confidence double, top double, grounded boolean"
    df = spark.createDataFrame([tuple(row.values())], kinds)
    out = policy.escalation_decision(
        F.col("message"), F.col("intent"), F.col("confidence"), F.col("top"), F.col("grounded"),
        F.lit(None).cast("array<string>"), F.lit(None).cast("boolean"),
    )
    got = df.select(out.alias("o")).select("o.*").first()
    assert got.reason_code == code and got.decision == ("ESCALATE" if code else "AUTO_HANDLE")
    assert (got.reason is not None) == (code is not None)


def _csv(path, columns, rows):
    path.write_text("\n".join([",".join(columns), *(",".join(r[c] for c in columns) for r in rows)]) + "\n")


def test_csv_columns_by_name(spark, tmp_path):
    columns = ["extra", *reversed(TWEET_COLUMNS)]
    rows = [{c: f"{c}{i}" for c in columns} for i in range(3)]
    _csv(tmp_path / "t.csv", columns, rows)
    got = read_tweets_csv(spark, str(tmp_path / "t.csv")).orderBy("ingest_seq").collect()
    assert [{c: r[c] for c in columns} for r in got] == rows
    assert normalize_tweets(read_tweets_csv(spark, str(tmp_path / "t.csv"))).count() == 3


def test_csv_without_a_column_is_a_named_error(spark, tmp_path):
    columns = [c for c in TWEET_COLUMNS if c != "text"]
    _csv(tmp_path / "t.csv", columns, [{c: "x" for c in columns}])
    with pytest.raises(SchemaError, match="text"):
        read_tweets_csv(spark, str(tmp_path / "t.csv"))


def test_csv_rows_keep_file_and_line_order(spark, tmp_path):
    sizes = [3, 60, 7]
    for n, size in enumerate(sizes):
        _csv(tmp_path / f"part{n}.csv", TWEET_COLUMNS, [{c: f"{n}-{i:02d}" for c in TWEET_COLUMNS} for i in range(size)])
    got = [r.text for r in read_tweets_csv(spark, str(tmp_path)).orderBy("ingest_seq").collect()]
    assert got == [f"{n}-{i:02d}" for n, size in enumerate(sizes) for i in range(size)]


@pytest.mark.parametrize("value, read", [("Tue Oct 31 22:10:47 +0000 2017", True), ("Xyz Oct 31 22:10:47 +0000 2017", False), ("abcdOct 31 22:10:47 +0000 2017", False)])
def test_timestamps_need_a_weekday(spark, value, read):
    df = spark.createDataFrame([(value,)], "v string").select(parse_created_at(F.col("v")).isNotNull().alias("ok"))
    assert df.first().ok == read


def test_sample_has_the_target_with_repeated_rows(spark):
    rows = [(i // 2, i, "same" if i % 5 == 0 else f"text {i // 2} {'long ' * (i % 40)}", None if i % 9 == 0 else i) for i in range(160)]
    pairs = spark.createDataFrame(rows, "conversation_id string, pair_seq bigint, cleaned_text string, seconds bigint").withColumn(
        "timestamp", F.timestamp_seconds("seconds")
    )
    for target in (10, 20, 64):
        sample = sampling.stratified_sample(pairs, target).collect()
        assert len(sample) == target and len({r.pair_seq for r in sample}) == target
        assert len({r.cleaned_text for r in sample}) == target


def test_small_class_with_vectors_is_not_calibrated(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=2).tolist(), "rare" if i < 2 else "big" if i % 2 else "other") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, vec array<double>, intent string").withColumn("features", array_to_vector("vec"))
    model = classify.train_calibrated(df)
    assert isinstance(model, classify.TextClassifier)
    scored = model.probabilities(df.withColumnRenamed("doc_id", "qid")).collect()
    assert len(scored) == 60 and all(abs(sum(r.probs) - 1) < 1e-9 for r in scored)


def test_vocabulary_ties_go_by_gram(spark):
    df = spark.createDataFrame([(["b", "a", "c", "c"],), (["d", "a", "b"],)], "grams array<string>")
    model = classify.fit_text_features(df, 3)
    assert model.stages[0].vocabulary == ["a", "b", "c"]


def test_salts_follow_the_count(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 10)
    left = spark.createDataFrame([(i, "hot" if i < 95 else f"k{i}") for i in range(120)], "id bigint, k string")
    hot = {r.k: r._salts for r in skew.hot_keys(left, "k").collect()}
    assert hot == {"hot": 10}
    right = left.select("k").distinct().withColumn("v", F.upper("k"))
    joined = skew.lookup_join(left, right, "k", "id", skew.hot_keys(left, "k")).collect()
    assert sorted(r.id for r in joined) == list(range(120)) and all(r.v == r.k.upper() for r in joined)


def test_one_term_in_all_queries_and_queries_without_a_match(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 5)
    corpus = spark.createDataFrame(
        [(i, f"order parcel item{i}", f"reply {i}", "A") for i in range(30)], "doc_id bigint, customer_text string, support_reply string, intent string"
    )
    index = retrieval.build_index(corpus)
    queries = spark.createDataFrame([(i, "parcel" if i < 40 else "zzz") for i in range(80)], "qid bigint, text string")
    for heavy_df in (1000, 3):
        hits = retrieval.hybrid_topk(queries, index, 3, heavy_df=heavy_df)
        rows = retrieval.with_documents(hits, corpus).collect()
        by_query = {}
        for r in rows:
            by_query.setdefault(r.qid, []).append((r["rank"], r.doc_id, round(r.score, 6)))
        assert len(by_query) == 80 and all(len(v) == 3 for v in by_query.values())
        assert sorted(by_query[79]) == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]
        assert all(sorted(by_query[q]) == sorted(by_query[0]) for q in range(40))


def test_scores_that_round_to_nothing_are_no_hits(spark):
    queries = spark.createDataFrame([(1, "f", 1e-12)], "qid bigint, feature string, qw double")
    docs = spark.createDataFrame([("f", 1, 1.0, 2), ("f", 2, 1.0, 2)], "feature string, doc_id bigint, w double, df bigint")
    for heavy_df in (10, 1):
        assert similarity.sparse_topk(queries, docs, 2, heavy_df).count() == 0


def test_messages_without_a_score_escalate(spark):
    corpus = spark.createDataFrame([(0, "parcel lost", "we look into it", "A")], "doc_id bigint, customer_text string, support_reply string, intent string")
    messages = spark.createDataFrame([(1, "parcel lost"), (2, "parcel lost")], "qid bigint, message string")
    scored = lambda df: df.where("qid = 1").select("qid", F.array(F.lit(0.9), F.lit(0.1)).alias("probs"))
    rows = {r.qid: r for r in triage.triage(messages, scored, ["A", "B"], retrieval.build_index(corpus)).collect()}
    assert set(rows) == {1, 2} and rows[2].decision == "ESCALATE" and rows[2].reason_code == "UNKNOWN_INTENT"


def test_prompt_holds_the_rules_and_the_context(spark):
    corpus = spark.createDataFrame([(0, "parcel lost", "we look into it", "A")], "doc_id bigint, customer_text string, support_reply string, intent string")
    messages = spark.createDataFrame([(1, "parcel lost", "asked twice")], "qid bigint, message string, context string")
    scored = lambda df: df.select("qid", F.array(F.lit(0.9)).alias("probs"))
    prompt = triage.prompt_table(messages, scored, ["A"], retrieval.build_index(corpus)).first().prompt
    assert triage.SYSTEM_TEXT in prompt and "context: asked twice" in prompt and triage.ANSWER_FORMAT in prompt


def test_escalation_matrix_always_has_four_cells(spark):
    df = spark.createDataFrame([("ESCALATE", "ESCALATE"), ("ESCALATE", "ESCALATE")], "gold_escalate string, pred_decision string")
    got = {(r.gold_escalate, r.pred_decision): r.n for r in evaluate.escalation_matrix(df).collect()}
    assert got == {("ESCALATE", "ESCALATE"): 2, ("ESCALATE", "AUTO_HANDLE"): 0, ("AUTO_HANDLE", "ESCALATE"): 0, ("AUTO_HANDLE", "AUTO_HANDLE"): 0}


def test_pending_states(spark):
    assert leakage.leakage_report(None, None, None).first().status == evaluate.PENDING
    assert evaluate.evaluation_status(None).first().status == evaluate.PENDING
    ratings = spark.createDataFrame([("a",)], "example_id string")
    other = spark.createDataFrame([("b",)], "example_id string")
    assert agreement.agreement_status(ratings, other).first().status == "no_overlapping_examples"
    assert agreement.agreement_status(ratings, ratings).first().status == "ok"


def test_pairs_aggregate_no_texts(spark):
    rows = [("1", "c", True, "hello", "2", None, 0), ("1", "x", True, "later", None, None, 5), ("2", "b", False, "hi", None, "1", 1)]
    tweets = spark.createDataFrame(
        rows, "tweet_id string, author_id string, inbound boolean, text string, response_tweet_id string, in_response_to_tweet_id string, ingest_seq bigint"
    ).withColumn("created_at_parsed", F.lit(None).cast("timestamp"))
    pairs = threads.reconstruct_pairs(tweets)
    assert [(r.customer_text, r.support_text) for r in pairs.collect()] == [("hello", "hi")]
    assert "SortAggregate" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_intent_config(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("status: x\nintents:\n  - name: A\n    description: one\n    inclusion_rules: [r1, r2]\n    exclusion_rules: []\n    examples:\n  - name: B\n")
    (tmp_path / "b.json").write_text('{"intents": [{"name": "A", "examples": ["e"]}]}')
    (tmp_path / "c.json").write_text('{"intents": [{"description": "no name"}]}')
    rows = {r.name: r for r in read_intent_config(spark, str(tmp_path / "a.yaml")).collect()}
    assert rows["A"].inclusion_rules == ["r1", "r2"] and rows["A"].description == "one" and rows["B"].examples == []
    assert read_intent_config(spark, str(tmp_path / "b.json")).first().examples == ["e"]
    with pytest.raises(SchemaError):
        read_intent_config(spark, str(tmp_path / "c.json"))
