"""Small tables with known outcomes."""

from __future__ import annotations

import math
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlova.functions import text as tx
from parlova.functions.ids import first_valid_id, normalize_flag, parse_created_at
from parlova.functions.payload import PARSE_FAILURE_CLAIM, parse_payload, parse_ratings
from parlova.operators import agreement, brands, evaluate, golden, labels, leakage, profile, ranking, sampling, skew, threads
from parlova.operators import triage as tr
from parlova.operators.policy import escalation_decision
from parlova.schemas import TWEET_COLUMNS, SchemaError, intent_dimension, validate_columns
from parlova.sources import tables
from parlova.sources.tweets import bad_timestamp_count, normalize_tweets, read_tweets_csv


def _one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("o")).first().o


# --- schema and loading ---------------------------------------------------------


def test_schema_check_accepts_and_names_missing(spark):
    good = spark.createDataFrame([], ", ".join(f"{c} string" for c in TWEET_COLUMNS) + ", extra int")
    assert validate_columns(good, TWEET_COLUMNS) is good
    with pytest.raises(SchemaError, match="author_id"):
        validate_columns(spark.createDataFrame([], "tweet_id string, text string"), TWEET_COLUMNS)


@pytest.mark.parametrize(
    "value,want",
    [("True", True), (" TRUE ", True), ("false", False), ("1", False), ("", False), (None, False)],
)
def test_flag(spark, value, want):
    assert _one(spark, normalize_flag, value) is want


@pytest.mark.parametrize(
    "value,want",
    [
        ("Tue Oct 31 22:10:47 +0000 2017", datetime(2017, 10, 31, 22, 10, 47)),
        ("Tue Oct 31 22:10:47 +0200 2017", datetime(2017, 10, 31, 20, 10, 47)),
        ("2017-10-31 22:10:47", datetime(2017, 10, 31, 22, 10, 47)),
        ("soon", None),
        (None, None),
    ],
)
def test_created_at(spark, value, want):
    got = _one(spark, lambda c: F.date_format(parse_created_at(c), "yyyy-MM-dd HH:mm:ss"), value)
    assert got == (want and want.strftime("%Y-%m-%d %H:%M:%S"))


def test_csv_scan_keeps_ids_and_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "tweets.csv"
    path.write_text(
        ",".join(TWEET_COLUMNS)
        + '\n007,a1,True,bad,"two\nlines, ""quoted""",8,\n8,NA,false,Tue Oct 31 22:10:47 +0000 2017,null,,"007,9"\n'
    )
    rows = {r.tweet_id: r for r in normalize_tweets(read_tweets_csv(spark, str(path))).collect()}
    assert rows["007"].text == 'two\nlines, "quoted"' and rows["007"].inbound is True
    assert rows["8"].author_id == "NA" and rows["8"].text == "null"
    assert rows["007"].in_response_to_tweet_id is None and rows["8"].in_response_to_tweet_id == "007,9"
    assert bad_timestamp_count(normalize_tweets(read_tweets_csv(spark, str(path)))).first()[0] == 1


# --- text ------------------------------------------------------------------------


def test_clean_removes_urls_and_extra_spaces(spark):
    out = _one(spark, tx.clean_text, "Look  https://example.com/a?b=1   at  www.x.org this\n")
    assert out == "Look at this"


def test_mask_pii(spark):
    out = _one(spark, tx.mask_pii, "mail a.b+c@ex-ample.org or call 555-123-4567, not 12345")
    assert out == "mail [EMAIL] or call [PHONE], not 12345"


@pytest.mark.parametrize(
    "value,want",
    [
        ("x +1 (555) 123 4567 y", "x +[PHONE] y"),
        ("é5551234567", "é5551234567"),
        ("5551234567é", "5551234567é"),
        ("a+5551234567", "a[PHONE]"),
    ],
)
def test_phone_boundaries_are_unicode(spark, value, want):
    assert _one(spark, tx.mask_phones, value) == want


def test_mention_removal_hides_addresses_unless_masked_first(spark):
    text = "@help write to jane@host.tld @ñandú"
    assert _one(spark, tx.clean_text, text) == "write to jane.tld"
    assert _one(spark, lambda c: tx.clean_text(c, keep_mentions=True), text) == "@help write to [EMAIL] @ñandú"
    assert _one(spark, lambda c: tx.clean_text(c, mask_first=True), text) == "write to [EMAIL]"


@pytest.mark.parametrize("value,want", [(None, ""), ("", ""), (" \t\n", ""), ("Grüße @x", "Grüße")])
def test_clean_edge_cases(spark, value, want):
    assert _one(spark, tx.clean_text, value) == want


@pytest.mark.parametrize(
    "value,want",
    [("12", "12"), (" 12 ,34", "12"), ("", None), ("  ", None), ("nan", None), ("NaN", None), (None, None), (",5", None)],
)
def test_first_valid_id(spark, value, want):
    assert _one(spark, first_valid_id, value) == want


@pytest.mark.parametrize("n,want", [(0, "short"), (4, "short"), (5, "medium"), (15, "medium"), (16, "long")])
def test_length_bucket(spark, n, want):
    assert _one(spark, tx.length_bucket, " ".join(["w"] * n)) == want


def test_tokens(spark):
    assert _one(spark, tx.retrieval_tokens, "Don't PAY 20€!") == ["don't", "pay", "20"]
    assert _one(spark, tx.ngrams, "A be Cé_d e") == ["be", "cé_d", "be cé_d"]
    assert _one(spark, tx.ngrams, "a") == []


def test_keyword_rules_are_ordered_substrings(spark):
    assert _one(spark, labels.weak_label, "Reordering my delivered package") == "ORDER_OR_TRANSACTION"
    assert _one(spark, labels.weak_label, "I was CHARGED for a refund") == "PAYMENT_ISSUE"
    assert _one(spark, labels.weak_label, "hello") == "OTHER_OR_UNKNOWN"


def test_unsupported_numbers(spark):
    df = spark.createDataFrame(
        [("refund $20.50 in 3 Days", "about $20.50 in 3 days", False), ("in 3 days", "in 4 days", True), ("no number", "", False), ("$5", "none", True)],
        "a string, b string, want boolean",
    )
    rows = df.select("want", tx.has_unsupported_number(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


# --- model answers ------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw,reply,claims",
    [
        ('{"reply": "hi", "grounded": true}', "hi", []),
        ('```json\n{"reply": "hi", "unsupported_claims": ["x"]}\n```', "hi", ["x"]),
        ('```\n{"reply": "hi"}\n```', "hi", []),
        ('Sure! {"reply": "hi"} bye', "hi", []),
        ('{"reply": "a"} {"reply": "b"}', None, [PARSE_FAILURE_CLAIM]),
        ('{"reply": "hi"', None, [PARSE_FAILURE_CLAIM]),
        ("no json", None, [PARSE_FAILURE_CLAIM]),
        ("", None, [PARSE_FAILURE_CLAIM]),
        (None, None, [PARSE_FAILURE_CLAIM]),
        ('{"reply": ""}', "", []),
    ],
)
def test_payload(spark, raw, reply, claims):
    got = _one(spark, parse_payload, raw)
    assert got.reply == reply and got.unsupported_claims == claims


def test_ratings_need_every_dimension(spark):
    full = '{"groundedness":1,"relevance":2,"correctness":3,"helpfulness":4,"tone":5,"overall":3}'
    assert _one(spark, parse_ratings, full).tone == 5
    assert [_one(spark, parse_ratings, r).status for r in (full, '{"tone": 5}', "x", None)] == ["ok", "error", "error", "pending"]


# --- accounts and pairs ----------------------------------------------------------------


def _tweets(spark, rows):
    return spark.createDataFrame(
        rows,
        "tweet_id string, author_id string, inbound boolean, text string, in_response_to_tweet_id string, "
        "created_at_parsed timestamp, ingest_seq bigint",
    )


def _t(i, author, inbound, text, to=None, seq=None):
    return (str(i), author, inbound, text, to, datetime(2023, 1, 1), seq if seq is not None else i)


def test_pairs_with_malformed_and_missing_ids(spark):
    t = _tweets(spark, [_t(1, "c1", True, "help"), _t(2, "B", False, "reply", "1"), _t(3, "B", False, "orphan", "999,888"), _t(4, "B", False, "none", "nan"), _t(5, "B", False, "to brand", "2")])
    rows = threads.reconstruct_pairs(t, "B").collect()
    assert [(r.customer_text, r.support_text, r.conversation_id) for r in rows] == [("help", "reply", "1__2")]
    outcomes = {r.outcome: r.n for r in threads.pair_outcome_counts(t, "B").collect()}
    assert outcomes == {"pair": 1, "missing_customer": 1, "malformed_id": 1, "not_a_customer": 1}


def test_repeated_id_first_row_pairs_last_row_ranks(spark):
    t = _tweets(spark, [_t(1, "c1", True, "first", seq=1), _t(1, "c2", True, "second", seq=2), _t(2, "B", False, "r", "1", seq=3), _t(3, "B", False, "r", "1,7", seq=4)])
    assert {r.customer_author for r in threads.reconstruct_pairs(t).collect()} == {"c1"}
    assert threads.reconstruct_pairs(t).count() == 2
    r = brands.thread_stats(t).first()
    assert (r.n_complete_threads, r.n_distinct_customers) == (1, 1)
    assert brands.thread_stats(t, parse_ids=True).first().n_complete_threads == 2


@pytest.mark.parametrize("min_rows", [100, 10_000])
def test_one_message_answered_by_most_replies(spark, monkeypatch, min_rows):
    """A hot customer id is spread over many tasks and still joins every reply once."""
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", min_rows)
    rows = [_t(1, "c1", True, "hot"), _t(2, "c2", True, "cold")]
    rows += [_t(10 + i, f"B{i % 3}", False, f"r{i}", "1" if i % 5 else "2") for i in range(3000)]
    pairs = threads.reconstruct_pairs(_tweets(spark, rows))
    assert {r.customer_tweet_id: r["count"] for r in pairs.groupBy("customer_tweet_id").count().collect()} == {"1": 2400, "2": 600}
    t = _tweets(spark, rows)
    found = {r.in_response_to_tweet_id for r in skew.hot_keys(t, "in_response_to_tweet_id").collect()}
    assert found == ({"1", "2"} if min_rows == 100 else set())
    assert {r.author_id: r.n_complete_threads for r in brands.thread_stats(t).collect()} == {"B0": 1000, "B1": 1000, "B2": 1000}


def test_brand_ranking_and_selection(spark):
    rows = [_t(i, f"c{i}", True, "q") for i in range(60)]
    rows += [_t(100 + i, "BIG", False, "a", str(i)) for i in range(60)]
    rows += [_t(200 + i, "SMALL", False, "a", str(i)) for i in range(10)]
    t = _tweets(spark, rows)
    ranked = brands.rank_brand_candidates(t)
    assert [(r.author_id, r.score, r.outbound_share) for r in ranked.collect()] == [("BIG", 60 + 90.0, 1.0)]
    assert brands.select_brand(ranked).first().brand_id == "BIG"
    with pytest.raises(ValueError, match="BIG"):
        brands.select_brand(ranked, "SMALL")
    with pytest.raises(ValueError, match="thresholds"):
        brands.select_brand(brands.rank_brand_candidates(t, min_distinct_customers=61))


# --- ranks, splits, samples --------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 10, 503])
def test_global_rank_and_quartiles(spark, n):
    df = spark.range(n).select(F.col("id"), (F.col("id") * 7919 % 5).alias("t"))
    ranked = ranking.global_rank(df, ["t", "id"])
    assert ranked.n == n
    got = ranked.rows.withColumn("q", ranking.quartile_of_rank(F.col("rank"), n)).toPandas().sort_values(["t", "id"])
    assert got["rank"].tolist() == list(range(1, n + 1))
    if n > 1:
        want = pd.qcut(pd.Series(range(1, n + 1)), 4, labels=[1, 2, 3, 4]).astype(int).tolist()
        assert got["q"].tolist() == want


def _pairs(spark, n, same_time=False):
    rows = [
        (f"p{i}", " ".join(["w"] * (1 + i % 20)) + f" {i}", i, None if i % 10 == 9 else datetime(2023, 1, 1 + (0 if same_time else i % 28)))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "conversation_id string, cleaned_text string, pair_seq bigint, timestamp timestamp").withColumn(
        "raw_text", F.col("cleaned_text")
    )


@pytest.mark.parametrize("n,same_time", [(0, False), (1, False), (2, True), (100, False), (100, True)])
def test_split_sizes_and_order(spark, n, same_time):
    out = sampling.chronological_split(_pairs(spark, n, same_time)).toPandas()
    timed = n - len(range(9, n, 10))
    assert len(out) == timed
    sizes = out["split"].value_counts().to_dict()
    assert sizes.get("train", 0) == int(timed * 0.7) and sizes.get("val", 0) == int(timed * 0.15)
    ordered = out.sort_values(["timestamp", "pair_seq"])
    assert ordered["split"].tolist() == sorted(ordered["split"], key=["train", "val", "test"].index)


def test_split_drops_golden_texts(spark):
    pairs = _pairs(spark, 40)
    texts = pairs.where(F.col("pair_seq") < 5).select("cleaned_text")
    assert sampling.chronological_split(pairs, golden_texts=texts).where(F.col("pair_seq") < 5).count() == 0


@pytest.mark.parametrize("target", [4, 30, 75, 500])
def test_stratified_sample(spark, target):
    pairs = _pairs(spark, 100)
    sample = sampling.stratified_sample(pairs, target).toPandas()
    assert len(sample) == min(target, 100) and sample["conversation_id"].is_unique
    again = sampling.stratified_sample(pairs.repartition(5), target).toPandas()
    assert set(sample["conversation_id"]) == set(again["conversation_id"])
    if target == 30:
        counts = sample.dropna(subset=["time_quartile"]).groupby(["length_bucket", "time_quartile"]).size()
        assert counts.min() >= 1 and len(counts) == 12
    named = sampling.golden_candidates(sampling.stratified_sample(pairs, target)).toPandas()
    assert sorted(named["example_id"])[0] == "golden_0000" and named["gold_intent"].isna().all()


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 3, "only")], "k string, seq int, v string")
    assert {(r.k, r.v) for r in sampling.dedup_keep_first(df, "k", "seq").collect()} == {("a", "early"), ("b", "only")}


# --- golden set and leakage ----------------------------------------------------------------


def _golden(spark, n, **changes):
    rows = []
    for i in range(n):
        row = {"example_id": f"g{i}", "customer_text": f"text {i}", "gold_intent": "CANCELLATION", "gold_escalate": "AUTO_HANDLE", "gold_escalation_reason": None}
        row.update(changes.get(f"r{i}", {}))
        rows.append(tuple(row.values()))
    return spark.createDataFrame(
        rows, "example_id string, customer_text string, gold_intent string, gold_escalate string, gold_escalation_reason string"
    )


def _bad(spark, g):
    return {r.check: (r.n_bad, r.severity) for r in golden.golden_set_checks(g, intent_dimension(spark)).where("not passed").collect()}


@pytest.mark.parametrize("n,ok", [(149, False), (150, True), (250, True), (251, False)])
def test_golden_size(spark, n, ok):
    assert _bad(spark, _golden(spark, n)) == ({} if ok else {"size_out_of_range": (n, "error")})


def test_golden_defects(spark):
    g = _golden(
        spark, 200, r0={"customer_text": "text 1"}, r2={"gold_intent": "WHAT"}, r3={"gold_intent": " "}, r4={"gold_escalate": None},
        r5={"gold_escalate": "ESCALATE"}, r6={"gold_escalate": "ESCALATE", "gold_escalation_reason": "NOPE"}, r7={"example_id": "g8"},
    )
    bad = _bad(spark, g)
    assert bad == {
        "duplicate_example_id": (1, "error"), "duplicate_customer_text": (1, "error"), "missing_gold_intent": (1, "error"),
        "missing_gold_escalate": (1, "error"), "unknown_intent_value": (2, "error"), "escalation_without_reason": (1, "error"),
        "unknown_reason_code": (1, "error"), "rare_intent": (2, "warning"),
    }


def test_rare_intents_alone_do_not_fail(spark):
    checks = golden.golden_set_checks(_golden(spark, 160, r1={"gold_intent": "REFUND_REQUEST"}), intent_dimension(spark))
    assert checks.where("not passed").first().check == "rare_intent"
    assert checks.agg(golden.golden_set_passes(checks).alias("ok")).first().ok is True


def test_leakage_states(spark):
    splits = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "test")], "cleaned_text string, split string")
    corpus = spark.createDataFrame([("a",)], "customer_text string")
    clean = spark.createDataFrame([("z",)], "customer_text string")
    def status(g, s, c):
        return {r.check: (r.passed, r.status) for r in leakage.leakage_report(g, s, c).collect()}
    assert all(v == (True, "PASS") for v in status(clean, splits, corpus).values())
    assert status(clean, splits, None)["golden_not_in_retrieval_index"] == (None, "PARTIAL_PENDING")
    dirty = spark.createDataFrame([("a",)], "customer_text string")
    assert status(dirty, splits, corpus)["golden_not_in_train"] == (False, "FAIL")
    derived = spark.createDataFrame([("z", "x")], "customer_text string, pred_intent string")
    assert status(derived, None, None)["golden_labels_not_derived_from_predictions"] == (False, "FAIL")
    twice = splits.union(spark.createDataFrame([("a", "val")], splits.schema))
    assert status(clean, twice, corpus)["no_cross_split_duplicates"] == (False, "FAIL")


# --- policy --------------------------------------------------------------------------------

BASE = {"message": "my card failed", "intent": "PAYMENT_ISSUE", "confidence": 0.9, "score": 0.8, "grounded": True, "claims": [], "conflict": False, "repeated": False}


@pytest.mark.parametrize(
    "change,code",
    [
        ({}, None),
        ({"intent": "OTHER_OR_UNKNOWN"}, "UNKNOWN_INTENT"),
        ({"confidence": 0.59}, "LOW_INTENT_CONFIDENCE"),
        ({"confidence": 0.60}, None),
        ({"message": "Please DELETE my account", "confidence": 0.7}, "SENSITIVE_ACCOUNT_ACTION"),
        ({"message": "this is Fraud"}, "HIGH_RISK_REQUEST"),
        ({"repeated": True, "conflict": True}, "REPEATED_FAILURE"),
        ({"conflict": True, "score": 0.1}, "CONFLICTING_HISTORY"),
        ({"score": 0.1}, "NO_RELEVANT_HISTORY"),
        ({"score": None}, "NO_RELEVANT_HISTORY"),
        ({"score": 0.35}, None),
        ({"grounded": False}, "UNSUPPORTED_INFORMATION"),
        ({"claims": ["a refund"]}, "UNSUPPORTED_INFORMATION"),
    ],
)
def test_policy(spark, change, code):
    row = {**BASE, **change}
    df = spark.createDataFrame(
        [tuple(row.values())],
        "message string, intent string, confidence double, score double, grounded boolean, claims array<string>, conflict boolean, repeated boolean",
    )
    c = F.col
    o = df.select(escalation_decision(c("message"), c("intent"), c("confidence"), c("score"), c("grounded"), c("claims"), c("conflict"), c("repeated")).alias("o")).first().o
    assert (o.decision, o.reason_code) == ("ESCALATE" if code else "AUTO_HANDLE", code)
    assert (o.reason is None) == (code is None)


def _retrieved(spark, *hits):
    items = [(i + 1, s, r) for i, (s, r) in enumerate(hits)]
    return spark.createDataFrame([(items,)], "retrieved array<struct<rank:int,score:double,support_reply:string>>")


@pytest.mark.parametrize(
    "hits,want",
    [
        ([(0.9, "a b"), (0.76, "c d")], True),
        ([(0.9, "a b"), (0.74, "c d")], False),
        ([(0.5, "a b"), (0.5, "a d")], False),
        ([(0.5, "a b"), (0.5, "  ")], False),
        ([(0.5, "a b")], False),
        ([], False),
    ],
)
def test_conflict(spark, hits, want):
    assert _retrieved(spark, *hits).select(tr.conflicting_history(F.col("retrieved"))).first()[0] is want


def test_conflict_limits(spark):
    """A gap of exactly 0.15 still competes; an overlap of exactly 0.05 is no conflict."""
    a = " ".join(f"a{i}" for i in range(10)) + " same"
    b = " ".join(f"b{i}" for i in range(9)) + " same"
    assert _retrieved(spark, (0.15, "x"), (0.0, "y")).select(tr.conflicting_history(F.col("retrieved"))).first()[0] is True
    assert _retrieved(spark, (0.5, a), (0.5, b)).select(tr.conflicting_history(F.col("retrieved"))).first()[0] is False


@pytest.mark.parametrize("score,mode", [(0.35, "fallback_retrieval"), (0.34, "fallback_no_evidence"), (None, "fallback_no_evidence")])
def test_draft(spark, score, mode):
    hits = [] if score is None else [(score, "do this")]
    d = _retrieved(spark, *hits).select(tr.draft_reply(F.col("retrieved")).alias("d")).first().d
    assert d.generation_mode == mode and d.grounded == (mode == "fallback_retrieval")
    assert d.reply == ("do this" if d.grounded else tr.NO_EVIDENCE_REPLY)


# --- metrics -------------------------------------------------------------------------------


def _predictions(spark, rows):
    return spark.createDataFrame(rows, "gold_intent string, pred_intent string, gold_escalate string, pred_decision string")


def test_classification_with_one_sided_labels(spark):
    p = _predictions(spark, [("a", "a", "", ""), ("a", "b", "", ""), ("c", "a", "", "")])
    m = evaluate.classification_metrics(p, "gold_intent", "pred_intent").first()
    assert m.n_labels == 3 and m.n_examples == 3
    assert math.isclose(m.accuracy, 1 / 3) and math.isclose(m.macro_f1, 0.5 / 3) and math.isclose(m.weighted_f1, 0.5 * 2 / 3)
    per = {r.label: (r.precision, r.recall, r.support) for r in evaluate.per_label_metrics(p, "gold_intent", "pred_intent").collect()}
    assert per == {"a": (0.5, 0.5, 2), "b": (0.0, 0.0, 0), "c": (0.0, 0.0, 1)}
    matrix = {(r.true_label, r.pred_label): r.n for r in evaluate.confusion_matrix(p, "gold_intent", "pred_intent").collect()}
    assert len(matrix) == 9 and matrix["a", "b"] == 1 and matrix["b", "b"] == 0


def test_escalation_metrics(spark):
    e, a = "ESCALATE", "AUTO_HANDLE"
    m = evaluate.escalation_metrics(_predictions(spark, [("", "", g, p) for g, p in [(e, e), (e, a), (a, a), (a, e)]])).first()
    assert (m.accuracy, m.precision_escalate, m.recall_escalate, m.f1_escalate) == (0.5, 0.5, 0.5, 0.5)
    assert (m.unsafe_auto_handling_count, m.unsafe_auto_handling_rate, m.automation_rate, m.auto_handle_accuracy) == (1, 0.25, 0.5, 0.5)
    none = evaluate.escalation_metrics(_predictions(spark, [("", "", e, e)])).first()
    assert none.auto_handle_accuracy is None and none.automation_rate == 0.0
    empty = evaluate.escalation_metrics(_predictions(spark, [])).first()
    assert empty.n_examples == 0 and empty.accuracy is None and empty.precision_escalate == 0.0


def test_reply_similarity(spark):
    df = spark.createDataFrame(
        [(1, "same words", "same words"), (2, "alpha beta", "beta gamma"), (3, "", "x y"), (4, "a", "b"), (5, None, "word")],
        "id int, a string, b string",
    )
    got = {r.id: r.similarity for r in evaluate.reply_similarity(df, "id", "a", "b").collect()}
    idf = math.log(1.5) + 1
    assert math.isclose(got[1], 1.0) and math.isclose(got[2], 1 / (1 + idf * idf)) and got[3] == got[4] == got[5] == 0.0


def test_failure_categories(spark):
    rows = [
        ("one two three four five", "a", "a", "ESCALATE", "ESCALATE", None),
        ("one two three four", "a", "b", "ESCALATE", "ESCALATE", "VERY_SHORT_MESSAGE"),
        ("one two three four five", "OTHER_OR_UNKNOWN", "b", "ESCALATE", "AUTO_HANDLE", "NOVEL_OR_AMBIGUOUS_INTENT"),
        ("one two three four five", "a", "a", "ESCALATE", "AUTO_HANDLE", "UNSAFE_AUTO_HANDLING"),
        ("one two three four five", "a", "b", "AUTO_HANDLE", "ESCALATE", "INTENT_MISCLASSIFICATION"),
        ("one two three four five", None, None, "ESCALATE", "ESCALATE", "INTENT_MISCLASSIFICATION"),
        ("one two three four five", "a", "a", "AUTO_HANDLE", "ESCALATE", "ESCALATION_THRESHOLD_ERROR"),
    ]
    df = spark.createDataFrame(rows, "customer_text string, gold_intent string, pred_intent string, gold_escalate string, pred_decision string, want string")
    assert all(r.want == r.got for r in df.select("want", evaluate.failure_category().alias("got")).collect())


def _kappa(spark, h, j):
    rows = [(f"e{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(h, j))]
    dims = ["groundedness", "relevance", "correctness", "helpfulness", "tone", "overall"]
    df = spark.createDataFrame(rows, "example_id string, h double, j double")
    human = df.select("example_id", *[F.col("h").alias(d) for d in dims])
    judge = df.select("example_id", *[F.col("j").alias(d) for d in dims])
    return agreement.judge_human_agreement(agreement.rating_pairs(human, judge)).where("dimension = 'tone'").first()


def test_kappa_weights_use_positions_not_scores(spark):
    """Ratings 1, 2, 5 without 3 and 4: the distance of 2 and 5 is one step."""
    h, j = [1, 2, 5, 5, 2, 1], [1, 5, 5, 2, 2, 2]
    pos = {1: 0, 2: 1, 5: 2}
    observed = sum(abs(pos[a] - pos[b]) for a, b in zip(h, j)) / 6
    expected = sum(abs(pos[a] - pos[b]) for a in h for b in j) / 36
    r = _kappa(spark, h, j)
    assert math.isclose(r.weighted_kappa, 1 - observed / expected)
    assert math.isclose(r.exact_agreement, 3 / 6) and math.isclose(r.pearson_correlation, pd.Series(h).corr(pd.Series(j)))


def test_constant_ratings(spark):
    r = _kappa(spark, [4, 4, 4], [4, 4, 4])
    assert r.pearson_correlation is None and r.weighted_kappa is None and r.exact_agreement == 1.0


def test_half_ratings_round_to_even(spark):
    assert math.isclose(_kappa(spark, [2.5, 1, 3], [2, 1, 3]).weighted_kappa, 1.0)


def test_incomplete_human_scores_are_rejected_whole(spark):
    dims = "groundedness int, relevance int, correctness int, helpfulness int, tone int, overall int"
    good = spark.createDataFrame([("a", 1, 1, 1, 1, 1, 1)], f"example_id string, {dims}")
    bad = good.union(spark.createDataFrame([("b", 1, None, 1, 1, 1, 1)], good.schema))
    assert tables.usable_human_scores(good).count() == 1 and tables.usable_human_scores(bad).count() == 0
    with pytest.raises(SchemaError):
        tables.usable_human_scores(good.drop("tone"))


# --- profile -------------------------------------------------------------------------------


def test_profile_counts(spark):
    t = _tweets(spark, [_t(1, "a", True, "x"), _t(1, "a", True, "x"), _t(2, None, False, None)]).withColumn("ingest_seq", F.monotonically_increasing_id())
    r = profile.dataset_summary(t).first()
    assert (r.n_rows, r.duplicate_row_count, r.duplicate_tweet_id_count, r.inbound_count, r.outbound_count, r.unique_authors) == (3, 1, 1, 2, 1, 1)
    assert {x.column_name: x.n_null for x in profile.null_counts(t.select("author_id", "text")).collect()} == {"author_id": 1, "text": 1}


def test_histogram_of_equal_lengths(spark):
    df = spark.createDataFrame([("a b",), ("c d",)], "t string")
    assert [(r.bin, r.n) for r in profile.length_histogram(df, F.col("t")).collect()] == [(0, 2)]


def test_reports_and_intents_survive_storage(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n bigint")
    tables.write_report_csv(df, str(tmp_path / "csv"))
    tables.write_metrics_json(df, str(tmp_path / "json"))
    tables.write_table(df, str(tmp_path / "parquet"), ["name"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert {(r.name, r.n) for r in spark.read.schema(df.schema).json(str(tmp_path / "json")).collect()} == {("a", 1), ("b", 2)}
    assert tables.read_table(spark, str(tmp_path / "parquet")).where("name = 'b'").first().n == 2
    dim = intent_dimension(spark, [{"name": "X", "examples": ["one"]}]).first()
    assert dim.name == "X" and dim.examples == ["one"] and dim.inclusion_rules == []


def test_golden_rows_without_annotation_are_pending(spark):
    g = _golden(spark, 3, r0={"gold_intent": None}, r1={"gold_escalate": None}, r2={"gold_intent": None})
    assert tables.complete_golden_rows(g).isEmpty()
    assert golden.golden_completion(g).first().completion_pct == pytest.approx(100 / 3)
