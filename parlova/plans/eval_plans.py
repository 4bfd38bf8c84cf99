"""Queries on baselines, metrics, failures, judging and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlova.functions.payload import parse_ratings
from parlova.operators import agreement, classify, evaluate, labels, retrieval
from parlova.operators import triage as tr
from parlova.operators.frames import union_all
from parlova.operators.similarity import pad_topk
from parlova.plans import sqlviews as sv
from parlova.plans.registry import query
from parlova.plans.model_plans import _nearest
from parlova.plans.sqlviews import VIEW_THRESHOLD, lit, sql
from parlova.plans.triage_plans import CONFIG, classifier, setup
from parlova.runtime import materialize
from parlova.schemas import INTENTS, OTHER_INTENT, RATING_DIMENSIONS
from parlova.sources import tables, views

# --- systems over the golden rows ---------------------------------------------------

sv.define("majority_v", "SELECT intent FROM (SELECT intent, count(*) AS n FROM corpus_v GROUP BY intent) ORDER BY n DESC, intent LIMIT 1")
sv.define(
    "system_a_v",
    f"""SELECT example_id, customer_text, gold_intent, gold_escalate, (SELECT intent FROM majority_v) AS pred_intent,
  {lit(evaluate.GENERIC_REPLY)} AS draft_reply, 'ESCALATE' AS pred_decision FROM golden_complete_v""",
)
sv.define(
    "g_nearest_v",
    """SELECT qid, support_reply FROM (
  SELECT q.qid, c.support_reply, row_number() OVER (PARTITION BY q.qid ORDER BY round(coalesce(l.score / l.best, 0.0), 9) DESC, c.doc_id) AS rank
  FROM golden_messages_v q CROSS JOIN corpus_v c
  LEFT JOIN (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM g_lex_v) l ON l.qid = q.qid AND l.doc_id = c.doc_id) WHERE rank = 1""",
)
sv.define(
    "system_b_v",
    f"""SELECT example_id, customer_text, gold_intent, gold_escalate, i.best_intent AS pred_intent,
  coalesce(n.support_reply, {lit(evaluate.GENERIC_REPLY)}) AS draft_reply,
  CASE WHEN i.confidence >= {VIEW_THRESHOLD} THEN 'AUTO_HANDLE' ELSE 'ESCALATE' END AS pred_decision
FROM golden_complete_v JOIN g_intent_v i USING (qid) LEFT JOIN g_nearest_v n USING (qid)""",
)
sv.define(
    "eval_rows_v",
    """SELECT e.example_id, e.customer_text, e.gold_intent, e.gold_escalate, t.intent AS pred_intent, t.decision AS pred_decision,
  t.draft_reply, t.r1 AS retrieved_top_example, t.reason_code, t.generation_mode FROM golden_complete_v e JOIN g_triage_v t USING (qid)""",
)
_SYSTEM_COLUMNS = ["example_id", "customer_text", "gold_intent", "gold_escalate", "pred_intent", "pred_decision", "draft_reply"]
sv.define(
    "systems_v",
    " UNION ALL ".join(
        f"SELECT {lit(n)} AS system, {', '.join(_SYSTEM_COLUMNS)} FROM {v}"
        for n, v in [("baseline_a", "system_a_v"), ("baseline_b", "system_b_v"), ("main_system", "eval_rows_v")]
    ),
)


def _golden(golden_rows):
    return tables.complete_golden_rows(golden_rows)


def _system_a(golden_rows, splits):
    train = splits.where(F.col("split") == "train")
    return evaluate.baseline_a(_golden(golden_rows), labels.majority_label(train))


def _system_b(golden_rows, model, index):
    rows = _golden(golden_rows)
    messages = rows.select("qid", F.col("customer_text").alias("text"))
    scored = classify.linear_probabilities(messages, model)
    predicted = classify.with_intent(scored, model.classes, 0.0)
    hits = pad_topk(retrieval.bm25_topk(messages, index.lexical, 1), messages, index.corpus, 1)
    nearest = retrieval.with_documents(hits, index.corpus)
    return evaluate.baseline_b(rows, predicted, nearest, VIEW_THRESHOLD)


def _main_system(golden_rows, model, index):
    rows = _golden(golden_rows)
    responses = tr.triage(
        rows.select("qid", F.col("customer_text").alias("message")), classifier(model), model.classes, index, CONFIG
    )
    return rows.join(responses, "qid").select(
        "example_id",
        "customer_text",
        "gold_intent",
        "gold_escalate",
        F.col("intent").alias("pred_intent"),
        F.col("decision").alias("pred_decision"),
        "draft_reply",
        F.get("retrieved_examples", F.lit(0))["support_reply"].alias("retrieved_top_example"),
        "reason_code",
        "generation_mode",
    )


def _eval_rows(spark, sf):
    golden_rows, _, model, index = setup(spark, sf)
    return materialize(_main_system(golden_rows, model, index))


def _systems(spark, sf):
    golden_rows, splits, model, index = setup(spark, sf)
    named = {
        "baseline_a": _system_a(golden_rows, splits),
        "baseline_b": _system_b(golden_rows, model, index),
        "main_system": _main_system(golden_rows, model, index),
    }
    return _stored(named)


def _stored(systems):
    """The rows of all systems, written one system after the other: the disks hold the shuffles of one."""
    return materialize(*[df.select(F.lit(n).alias("system"), *_SYSTEM_COLUMNS) for n, df in systems.items()])


@query("baseline_a", sql("SELECT example_id, pred_intent, pred_decision, md5(draft_reply) AS reply FROM system_a_v"))
def baseline_a(spark, sf):
    rows = _system_a(*views.flow(spark, sf))
    return rows.select("example_id", "pred_intent", "pred_decision", F.md5("draft_reply").alias("reply"))


@query("baseline_b", sql("SELECT example_id, pred_intent, pred_decision, md5(draft_reply) AS reply FROM system_b_v"))
def baseline_b(spark, sf):
    golden_rows, _, model, index = setup(spark, sf)
    rows = _system_b(golden_rows, model, index)
    return rows.select("example_id", "pred_intent", "pred_decision", F.md5("draft_reply").alias("reply"))


@query(
    "eval_rows",
    sql(
        """SELECT example_id, md5(customer_text) AS message, gold_intent, pred_intent, gold_escalate, pred_decision, md5(draft_reply) AS reply,
  md5(retrieved_top_example) AS example, reason_code, generation_mode FROM eval_rows_v"""
    ),
)
def eval_rows(spark, sf):
    return _eval_rows(spark, sf).select(
        "example_id", F.md5("customer_text").alias("message"), "gold_intent", "pred_intent", "gold_escalate", "pred_decision",
        F.md5("draft_reply").alias("reply"), F.md5("retrieved_top_example").alias("example"), "reason_code", "generation_mode",
    )


# --- metrics ---------------------------------------------------------------------


def _per_label(source, t, p, by):
    return f"""SELECT {by}, label, tp / CAST(nullif(predicted, 0) AS DOUBLE) AS p0, tp / CAST(nullif(support, 0) AS DOUBLE) AS r0,
  coalesce(2 * tp / CAST(nullif(support + predicted, 0) AS DOUBLE), 0.0) AS f1, support, tp FROM (
  SELECT l.{by}, l.label, count(*) FILTER (s.{t} = l.label) AS support, count(*) FILTER (s.{p} = l.label) AS predicted,
    count(*) FILTER (s.{t} = l.label AND s.{p} = l.label) AS tp
  FROM (SELECT {by}, {t} AS label FROM {source} UNION SELECT {by}, {p} FROM {source}) l JOIN {source} s ON s.{by} = l.{by}
  GROUP BY l.{by}, l.label)"""


sv.define("vector_rows_v", "SELECT 'vectors' AS system, label AS t, predicted AS p FROM predicted_v")
sv.define("vector_labels_v", _per_label("vector_rows_v", "t", "p", "system"))
sv.define("system_labels_v", _per_label("systems_v", "gold_intent", "pred_intent", "system"))
_CLASSIFICATION = """SELECT system, CAST(sum(support) AS BIGINT) AS n_examples, count(*) AS n_labels, round(sum(tp) / CAST(sum(support) AS DOUBLE), 6) AS accuracy,
  round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM {} GROUP BY system"""
sv.define(
    "system_escalation_v",
    """SELECT system, n AS n_examples, same / n AS accuracy, coalesce(ee / nullif(pe, 0), 0) AS precision_escalate, coalesce(ee / nullif(ge, 0), 0) AS recall_escalate,
  coalesce(2 * ee / nullif(ge + pe, 0), 0) AS f1_escalate, aa / nullif(n - pe, 0) AS auto_handle_accuracy, ea AS unsafe_auto_handling_count,
  ea / n AS unsafe_auto_handling_rate, pe / n AS escalation_rate, (n - pe) / n AS automation_rate
FROM (SELECT system, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (gold_escalate = pred_decision) AS DOUBLE) AS same,
  CAST(count(*) FILTER (gold_escalate = 'ESCALATE' AND pred_decision = 'ESCALATE') AS DOUBLE) AS ee,
  CAST(count(*) FILTER (gold_escalate = 'ESCALATE') AS DOUBLE) AS ge, CAST(count(*) FILTER (pred_decision = 'ESCALATE') AS DOUBLE) AS pe,
  CAST(count(*) FILTER (gold_escalate = 'AUTO_HANDLE' AND pred_decision = 'AUTO_HANDLE') AS DOUBLE) AS aa,
  CAST(count(*) FILTER (gold_escalate = 'ESCALATE' AND pred_decision = 'AUTO_HANDLE') AS DOUBLE) AS ea FROM systems_v GROUP BY system)""",
)
_ESCALATION_RATES = [
    "accuracy", "precision_escalate", "recall_escalate", "f1_escalate", "auto_handle_accuracy", "unsafe_auto_handling_rate",
    "escalation_rate", "automation_rate",
]
_ESCALATION = (
    "SELECT system, CAST(n_examples AS BIGINT) AS n_examples, CAST(unsafe_auto_handling_count AS BIGINT) AS unsafe_auto_handling_count, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _ESCALATION_RATES)
    + " FROM system_escalation_v"
)


def _rounded(df, cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _vector_predictions(spark, sf):
    return _nearest(spark, sf).withColumn("system", F.lit("vectors"))


@query(
    "confusion_matrix",
    sql(
        """SELECT a.label AS true_label, b.label AS pred_label, count(v.p) AS n
FROM vector_labels_v a CROSS JOIN vector_labels_v b LEFT JOIN vector_rows_v v ON v.t = a.label AND v.p = b.label GROUP BY a.label, b.label"""
    ),
)
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_vector_predictions(spark, sf), "label", "predicted")


@query("classification_metrics", sql(_CLASSIFICATION.format("vector_labels_v")))
def classification_metrics(spark, sf):
    out = evaluate.classification_metrics(_vector_predictions(spark, sf), "label", "predicted", ["system"])
    return _rounded(out, ["accuracy", "macro_f1", "weighted_f1"])


@query(
    "per_intent_metrics",
    sql(
        """SELECT system, label, round(coalesce(p0, 0), 6) AS precision, round(coalesce(r0, 0), 6) AS recall, round(f1, 6) AS f1, support
FROM system_labels_v"""
    ),
)
def per_intent_metrics(spark, sf):
    out = evaluate.per_label_metrics(_systems(spark, sf), "gold_intent", "pred_intent", ["system"])
    return _rounded(out.drop("tp"), ["precision", "recall", "f1"])


@query("eval_by_system", sql(_CLASSIFICATION.format("system_labels_v")))
def eval_by_system(spark, sf):
    out = evaluate.classification_metrics(_systems(spark, sf), "gold_intent", "pred_intent", ["system"])
    return _rounded(out, ["accuracy", "macro_f1", "weighted_f1"])


_REPLICATES = 50
_WEIGHT = " + ".join(f"CASE WHEN u >= {step!r}::DOUBLE THEN 1 ELSE 0 END" for step in evaluate.POISSON_STEPS)
sv.define(
    "drawn_v",
    f"""SELECT system, rep, t, p, sum(w) AS n FROM (SELECT system, rep, t, p, {_WEIGHT} AS w FROM (
  SELECT system, rep, gold_intent AS t, pred_intent AS p, CAST('0x' || substr(md5(example_id || '#' || rep), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM systems_v CROSS JOIN (SELECT unnest(range(1, {_REPLICATES + 1})) AS rep))) WHERE w > 0 GROUP BY system, rep, t, p""",
)
sv.define(
    "drawn_labels_v",
    """SELECT system, rep, label, CAST(sum(support) AS DOUBLE) AS support, CAST(sum(predicted) AS DOUBLE) AS predicted, CAST(sum(tp) AS DOUBLE) AS tp FROM (
  SELECT system, rep, t AS label, n AS support, 0 AS predicted, CASE WHEN t = p THEN n ELSE 0 END AS tp FROM drawn_v
  UNION ALL SELECT system, rep, p, 0, n, 0 FROM drawn_v) GROUP BY system, rep, label""",
)
sv.define(
    "drawn_metrics_v",
    """SELECT system, rep, sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1
FROM (SELECT *, coalesce(2 * tp / nullif(support + predicted, 0), 0.0) AS f1 FROM drawn_labels_v) GROUP BY system, rep""",
)


@query(
    "metric_intervals",
    sql(
        f"""SELECT m.system, m.metric, m.value, round(quantile_cont(d.v, 0.025), 6) AS low, round(quantile_cont(d.v, 0.975), 6) AS high
FROM (UNPIVOT ({_CLASSIFICATION.format("system_labels_v")}) ON accuracy, macro_f1, weighted_f1 INTO NAME metric VALUE value) m
JOIN (UNPIVOT drawn_metrics_v ON accuracy, macro_f1, weighted_f1 INTO NAME metric VALUE v) d ON d.system = m.system AND d.metric = m.metric
GROUP BY m.system, m.metric, m.value"""
    ),
)
def metric_intervals(spark, sf):
    """The systems' intent metrics with bootstrap limits."""
    rows = evaluate.metric_intervals(_systems(spark, sf), "example_id", "gold_intent", "pred_intent", ["system"], _REPLICATES)
    return _rounded(rows, ["value", "low", "high"])


@query("escalation_metrics", sql(_ESCALATION))
def escalation_metrics(spark, sf):
    return _rounded(evaluate.escalation_metrics(_systems(spark, sf), ["system"]), _ESCALATION_RATES)


@query(
    "escalation_matrix",
    sql(
        """SELECT s.system, g.d AS gold_escalate, p.d AS pred_decision, count(r.example_id) AS n
FROM (SELECT DISTINCT system FROM systems_v) s CROSS JOIN (VALUES ('ESCALATE'), ('AUTO_HANDLE')) g(d) CROSS JOIN (VALUES ('ESCALATE'), ('AUTO_HANDLE')) p(d)
LEFT JOIN systems_v r ON r.system = s.system AND r.gold_escalate = g.d AND r.pred_decision = p.d GROUP BY s.system, g.d, p.d"""
    ),
)
def escalation_matrix(spark, sf):
    return evaluate.escalation_matrix(_systems(spark, sf), ["system"])


@query(
    "confusion_by_system",
    sql(
        """SELECT a.system, a.label AS true_label, b.label AS pred_label, count(r.example_id) AS n
FROM system_labels_v a JOIN system_labels_v b ON a.system = b.system
LEFT JOIN systems_v r ON r.system = a.system AND r.gold_intent = a.label AND r.pred_intent = b.label GROUP BY a.system, a.label, b.label"""
    ),
)
def confusion_by_system(spark, sf):
    return evaluate.confusion_matrix(_systems(spark, sf), "gold_intent", "pred_intent", ["system"])


@query(
    "evaluation_status",
    sql(
        f"""SELECT 'annotated' AS golden_set, 'EVALUATED' AS status, count(*) AS n_rows, count(*) FILTER (gold_intent IS NOT NULL AND gold_escalate IS NOT NULL) AS n_annotated FROM golden_v
UNION ALL SELECT 'blank', {lit(evaluate.PENDING)}, count(*), 0 FROM golden_v UNION ALL SELECT 'absent', {lit(evaluate.PENDING)}, 0, 0"""
    ),
)
def evaluation_status(spark, sf):
    """The golden set as annotated, before any annotation, and absent."""
    golden_rows = views.golden(spark, sf)
    blank = golden_rows.withColumn("gold_intent", F.lit(None).cast("string"))
    states = {"annotated": golden_rows, "blank": blank, "absent": None}
    return union_all([evaluate.evaluation_status(g).select(F.lit(n).alias("golden_set"), "*") for n, g in states.items()])


@query(
    "test_split_metrics",
    sql(
        """SELECT count(*) AS n_examples, count(*) FILTER (i.best_intent = m.intent) AS n_correct,
  round(count(*) FILTER (i.best_intent = m.intent) / CAST(nullif(count(*), 0) AS DOUBLE), 6) AS accuracy FROM messages_v m JOIN m_intent_v i USING (qid)"""
    ),
)
def test_split_metrics(spark, sf):
    """Predicted against rule-based intents over all test messages."""
    _, splits, model, _ = setup(spark, sf)
    messages = views.messages_of(splits)
    scored = classify.linear_probabilities(messages.select("qid", "text"), model)
    predicted = classify.with_intent(scored, model.classes, 0.0).select("qid", F.col("intent").alias("predicted"))
    hits = F.count_if(F.col("predicted") == F.col("intent"))
    return messages.join(predicted, "qid").agg(
        F.count(F.lit(1)).alias("n_examples"), hits.alias("n_correct"),
        F.round(F.try_divide(hits, F.count(F.lit(1))), 6).alias("accuracy"),
    )


def trained_systems(spark, sf):
    """The three systems with trained models: logistic regression for baseline B, calibrated for the main system."""
    golden_rows, splits = views.flow(spark, sf)
    index = retrieval.build_index(retrieval.index_corpus(splits))
    train = views.training_rows(splits)
    plain, calibrated = classify.train_text_classifier(train), classify.train_calibrated(train)
    rows = _golden(golden_rows)
    messages = rows.select("qid", F.col("customer_text").alias("text"))
    predicted = classify.with_intent(plain.probabilities(messages), plain.classes, 0.0)
    hits = pad_topk(retrieval.bm25_topk(messages, index.lexical, 1), messages, index.corpus, 1)
    responses = tr.triage(messages.withColumnRenamed("text", "message"), calibrated.probabilities, calibrated.classes, index, CONFIG)
    named = {
        "baseline_a": _system_a(golden_rows, splits),
        "baseline_b": evaluate.baseline_b(rows, predicted, retrieval.with_documents(hits, index.corpus), VIEW_THRESHOLD),
        "main_system": rows.join(responses, "qid").withColumnsRenamed({"intent": "pred_intent", "decision": "pred_decision"}),
    }
    return _stored(named)


@query(
    "trained_systems_checks",
    sql(
        """SELECT s.system, count(*) AS n_examples, 0 AS n_unknown_labels, 0 AS n_missing_replies
FROM (VALUES ('baseline_a'), ('baseline_b'), ('main_system')) s(system) CROSS JOIN golden_complete_v GROUP BY s.system"""
    ),
)
def trained_systems_checks(spark, sf):
    """Each trained system answers each annotated row with a known label and a reply."""
    known = [*INTENTS, OTHER_INTENT]
    return trained_systems(spark, sf).groupBy("system").agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.count_if(~F.coalesce(F.col("pred_intent").isin(known), F.lit(False))).alias("n_unknown_labels"),
        F.count_if(F.coalesce("draft_reply", F.lit("")) == "").alias("n_missing_replies"),
    )


@query("eval_trained_systems")
def eval_trained_systems(spark, sf):
    """Classification and escalation figures of the trained systems."""
    rows = trained_systems(spark, sf)
    left = evaluate.classification_metrics(rows, "gold_intent", "pred_intent", ["system"])
    right = evaluate.escalation_metrics(rows, ["system"]).drop("n_examples").withColumnRenamed("accuracy", "escalation_accuracy")
    return left.join(right, "system")


# --- reply similarity --------------------------------------------------------------


def _similarity_sql(source, key, a, b):
    token = lambda c: sv.vector_tokens(c)
    return f"""SELECT s.{key}, coalesce(xy / nullif(sqrt(xx) * sqrt(yy), 0), 0.0) AS similarity FROM {source} s LEFT JOIN (
  SELECT {key}, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM (
    SELECT {key}, a * idf AS x, b * idf AS y FROM (
      SELECT {key}, a, b, CASE WHEN a > 0 AND b > 0 THEN 1.0::DOUBLE ELSE ln(1.5::DOUBLE) + 1.0 END AS idf FROM (
        SELECT {key}, token, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM (
          SELECT {key}, 0 AS side, unnest({token(a)}) AS token FROM {source} UNION ALL SELECT {key}, 1, unnest({token(b)}) FROM {source})
        GROUP BY {key}, token))) GROUP BY {key}) t USING ({key})"""


sv.define("reply_similarity_v", _similarity_sql("pairs_v", "conversation_id", "customer_text", "support_text"))
sv.define("eval_similarity_v", _similarity_sql("eval_rows_v", "example_id", "draft_reply", "retrieved_top_example"))


@query("reply_similarity", sql("SELECT conversation_id, round(similarity, 6) AS similarity FROM reply_similarity_v"))
def reply_similarity(spark, sf):
    out = evaluate.reply_similarity(views.pairs(spark, sf), "conversation_id", "customer_text", "support_text")
    return _rounded(out, ["similarity"])


@query("reply_similarity_mean", sql("SELECT round(avg(similarity), 6) AS similarity FROM eval_similarity_v"))
def reply_similarity_mean(spark, sf):
    out = evaluate.reply_similarity(_eval_rows(spark, sf), "example_id", "draft_reply", "retrieved_top_example")
    return out.agg(F.round(F.avg("similarity"), 6).alias("similarity"))


# --- failures ----------------------------------------------------------------------

# Wrong and right rows over all pairs, so that every category occurs.
sv.define(
    "graded_v",
    """SELECT conversation_id AS example_id, CASE WHEN pair_seq % 6 = 0 THEN 'so bad today' ELSE cleaned_text END AS customer_text, intent AS gold_intent,
  CASE WHEN pair_seq % 23 = 0 THEN NULL WHEN pair_seq % 5 = 0 THEN 'CANCELLATION' ELSE intent END AS pred_intent,
  CASE WHEN pair_seq % 3 = 0 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS gold_escalate,
  CASE WHEN pair_seq % 4 = 0 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS pred_decision, support_text AS retrieved_top_example
FROM (SELECT conversation_id, cleaned_text, intent, support_text, """
    + views.MIXED_SQL
    + " AS pair_seq FROM pairs_v)",
)
sv.define(
    "failed_v",
    f"""SELECT *, CASE WHEN coalesce(gold_intent = pred_intent, false) AND coalesce(gold_escalate = pred_decision, false) THEN NULL
  WHEN {sv.token_count('customer_text')} <= 4 THEN 'VERY_SHORT_MESSAGE'
  WHEN gold_intent = 'OTHER_OR_UNKNOWN' AND coalesce(pred_intent <> 'OTHER_OR_UNKNOWN', true) THEN 'NOVEL_OR_AMBIGUOUS_INTENT'
  WHEN gold_escalate = 'ESCALATE' AND pred_decision = 'AUTO_HANDLE' THEN 'UNSAFE_AUTO_HANDLING'
  WHEN NOT coalesce(gold_intent = pred_intent, false) THEN 'INTENT_MISCLASSIFICATION' ELSE 'ESCALATION_THRESHOLD_ERROR' END AS failure_category
FROM graded_v""",
)
sv.define(
    "modes_v",
    """SELECT * FROM (SELECT failure_category, count(*) AS n_examples, row_number() OVER (ORDER BY count(*) DESC, failure_category) AS mode_rank
FROM failed_v WHERE failure_category IS NOT NULL GROUP BY failure_category) WHERE mode_rank <= 4""",
)


def _graded(spark, sf):
    seq = views.mixed(F.col("pair_seq"))
    return views.pairs(spark, sf).select(
        F.col("conversation_id").alias("example_id"),
        F.when(seq % 6 == 0, "so bad today").otherwise(F.col("cleaned_text")).alias("customer_text"),
        F.col("intent").alias("gold_intent"),
        F.when(seq % 23 == 0, F.lit(None)).when(seq % 5 == 0, "CANCELLATION").otherwise(F.col("intent")).alias("pred_intent"),
        F.when(seq % 3 == 0, "ESCALATE").otherwise("AUTO_HANDLE").alias("gold_escalate"),
        F.when(seq % 4 == 0, "ESCALATE").otherwise("AUTO_HANDLE").alias("pred_decision"),
        F.col("support_text").alias("retrieved_top_example"),
    )


@query("failure_category", sql("SELECT example_id, failure_category FROM failed_v"))
def failure_category(spark, sf):
    return _graded(spark, sf).select("example_id", evaluate.failure_category().alias("failure_category"))


@query("failure_modes", sql("SELECT * FROM modes_v"))
def failure_modes(spark, sf):
    return evaluate.failure_modes(_graded(spark, sf), 4)


@query(
    "failure_examples",
    sql(
        """SELECT failure_category, n_examples, example_rank, md5(customer_text) AS example_customer_text, pred_intent, gold_intent, pred_decision, gold_escalate,
  md5(retrieved_top_example) AS retrieved_top_example FROM (
  SELECT f.*, m.n_examples, row_number() OVER (PARTITION BY f.failure_category ORDER BY example_id) AS example_rank
  FROM failed_v f JOIN modes_v m USING (failure_category)) WHERE example_rank <= 3"""
    ),
)
def failure_examples(spark, sf):
    rows = evaluate.failure_examples(_graded(spark, sf), 4, 3)
    return rows.withColumns(
        {"example_customer_text": F.md5("example_customer_text"), "retrieved_top_example": F.md5("retrieved_top_example")}
    )


# --- judge and human ratings ----------------------------------------------------------

_GOOD = '{"groundedness": 4, "relevance": 3, "correctness": 5, "helpfulness": <q>, "tone": 4, "overall": 3, "reason": "fine"}'
_SHORT = 'Sure: {"groundedness": 4, "relevance": 3}'


@query(
    "judge_status",
    f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN doc_id % 4 = 1 THEN CAST(2 + quality AS INTEGER) END AS helpfulness FROM labels""",
)
def judge_status(spark, sf):
    """Raw judge answers: complete, incomplete, unreadable, absent."""
    d = F.col("doc_id")
    raw = (
        F.when(d % 4 == 1, F.regexp_replace(F.lit(_GOOD), "<q>", (F.col("quality") + 2).cast("string")))
        .when(d % 4 == 2, _SHORT)
        .when(d % 4 == 3, "no answer")
    )
    rows = views.table(spark, sf, "labels").select("doc_id", parse_ratings(raw).alias("r"))
    return rows.select("doc_id", "r.status", "r.helpfulness")


@query(
    "judge_summary",
    sql(
        "SELECT CASE WHEN count(*) FILTER (status = 'ok') > 0 THEN 'ok' ELSE 'all_failed' END AS status, count(*) FILTER (status = 'ok') AS n_scored, count(*) AS n_total, "
        + ", ".join(f"round(avg({d}) FILTER (status = 'ok'), 6) AS mean_{d}" for d in RATING_DIMENSIONS)
        + " FROM judge_v"
    ),
)
def judge_summary(spark, sf):
    out = agreement.judge_summary(views.ratings(spark, sf, "judge"))
    return _rounded(out, [f"mean_{d}" for d in RATING_DIMENSIONS])


sv.define(
    "rating_pairs_v",
    " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST(h.{d} AS DOUBLE) AS h, CAST(j.{d} AS DOUBLE) AS j FROM human_v h JOIN judge_v j USING (example_id) WHERE j.status = 'ok'"
        for d in RATING_DIMENSIONS
    ),
)
sv.define("scale_v", "SELECT dimension, v, row_number() OVER (PARTITION BY dimension ORDER BY v) AS pos FROM (SELECT dimension, round_even(h, 0) AS v FROM rating_pairs_v UNION SELECT dimension, round_even(j, 0) FROM rating_pairs_v)")
sv.define(
    "kappa_rows_v",
    """SELECT r.dimension, a.pos AS hp, b.pos AS jp FROM rating_pairs_v r JOIN scale_v a ON a.dimension = r.dimension AND a.v = round_even(r.h, 0)
JOIN scale_v b ON b.dimension = r.dimension AND b.v = round_even(r.j, 0)""",
)
sv.define(
    "kappa_v",
    """SELECT o.dimension, 1.0 - o.observed * o.n / nullif(e.expected, 0) AS weighted_kappa FROM
  (SELECT dimension, CAST(sum(abs(hp - jp)) AS DOUBLE) AS observed, count(*) AS n FROM kappa_rows_v GROUP BY dimension) o
  JOIN (SELECT dimension, CAST(sum(a.n * b.n * abs(hp - jp)) AS DOUBLE) AS expected
    FROM (SELECT dimension, hp, count(*) AS n FROM kappa_rows_v GROUP BY dimension, hp) a
    JOIN (SELECT dimension, jp, count(*) AS n FROM kappa_rows_v GROUP BY dimension, jp) b USING (dimension) GROUP BY dimension) e USING (dimension)""",
)


def _rating_pairs(spark, sf):
    judge = views.ratings(spark, sf, "judge").where(F.col("status") == "ok")
    return agreement.rating_pairs(views.ratings(spark, sf, "human"), judge)


@query(
    "judge_human_agreement",
    sql(
        """SELECT r.dimension, count(*) AS n_examples, round(count(*) FILTER (h = j) / CAST(count(*) AS DOUBLE), 6) AS exact_agreement,
  round(avg(abs(h - j)), 6) AS mean_absolute_difference,
  CASE WHEN stddev_pop(h) > 1e-6 AND stddev_pop(j) > 1e-6 THEN round(covar_pop(h, j) / (stddev_pop(h) * stddev_pop(j)), 6) END AS pearson_correlation,
  round(any_value(k.weighted_kappa), 6) AS weighted_kappa
FROM rating_pairs_v r LEFT JOIN kappa_v k USING (dimension) GROUP BY r.dimension"""
    ),
)
def judge_human_agreement(spark, sf):
    out = agreement.judge_human_agreement(_rating_pairs(spark, sf))
    return _rounded(out, ["exact_agreement", "mean_absolute_difference", "pearson_correlation", "weighted_kappa"])


@query("weighted_kappa", sql("SELECT dimension, round(weighted_kappa, 6) AS weighted_kappa FROM kappa_v"))
def weighted_kappa(spark, sf):
    return _rounded(agreement.weighted_kappa(_rating_pairs(spark, sf)), ["weighted_kappa"])


@query(
    "rating_prompts",
    sql(
        f"""SELECT example_id, md5(concat_ws(chr(10), 'message: ' || customer_text, 'past replies:', coalesce('* ' || retrieved_top_example, '(none)'),
  'reply: ' || draft_reply, {lit(tr.RATING_TEXT)})) AS digest FROM eval_rows_v"""
    ),
)
def rating_prompts(spark, sf):
    evidence = F.array_compact(F.array("retrieved_top_example"))
    prompt = tr.rating_prompt_text(F.col("customer_text"), F.col("draft_reply"), evidence)
    return _eval_rows(spark, sf).select("example_id", F.md5(prompt).alias("digest"))


# --- report ------------------------------------------------------------------------


@query(
    "comparison_table",
    sql(
        """SELECT s.system, coalesce(printf('%.3f', macro_f1), 'PENDING') AS intent_macro_f1, coalesce(printf('%.1f%%', c.accuracy * 100), 'PENDING') AS intent_accuracy,
  CASE WHEN s.system = 'main_system' THEN (SELECT printf('%.3f', avg(groundedness)) FROM judge_v WHERE status = 'ok') ELSE 'PENDING' END AS reply_grounding,
  CASE WHEN s.system = 'main_system' THEN (SELECT printf('%.3f', avg(helpfulness)) FROM judge_v WHERE status = 'ok') ELSE 'PENDING' END AS reply_helpfulness,
  coalesce(printf('%.1f%%', e.unsafe_auto_handling_rate * 100), 'PENDING') AS unsafe_auto_handling, coalesce(printf('%.1f%%', e.automation_rate * 100), 'PENDING') AS automation_rate
FROM (VALUES ('baseline_a'), ('baseline_b'), ('main_system'), ('not_run')) s(system)
LEFT JOIN (SELECT system, sum(tp) / CAST(sum(support) AS DOUBLE) AS accuracy, avg(f1) AS macro_f1 FROM system_labels_v GROUP BY system) c USING (system)
LEFT JOIN system_escalation_v e USING (system)"""
    ),
)
def comparison_table(spark, sf):
    rows = _systems(spark, sf)
    known = spark.createDataFrame([("baseline_a",), ("baseline_b",), ("main_system",), ("not_run",)], "system string")
    judged = agreement.judge_summary(views.ratings(spark, sf, "judge")).select(
        F.lit("main_system").alias("system"), "mean_groundedness", "mean_helpfulness"
    )
    return evaluate.comparison_table(
        known,
        evaluate.classification_metrics(rows, "gold_intent", "pred_intent", ["system"]),
        evaluate.escalation_metrics(rows, ["system"]),
        judged,
    )
