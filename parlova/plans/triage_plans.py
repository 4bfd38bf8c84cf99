"""Queries on drafting, policy, triage and the stream."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from parlova.functions.ids import first_valid_id
from parlova.functions.payload import PARSE_FAILURE_CLAIM, parse_payload
from parlova.functions.text import clean_text
from parlova.operators import classify, history, policy, retrieval, thread_tree
from parlova.operators import triage as tr
from parlova.operators.labels import weak_label
from parlova.plans import sqlviews as sv
from parlova.plans.model_plans import VIEW_TARGET
from parlova.plans.registry import query
from parlova.plans.sqlviews import VIEW_MIN_SCORE, VIEW_THRESHOLD, sql
from parlova.runtime import materialize, scratch_path
from parlova.sources import views
from parlova.sources.views import VIEW_RISKY
from parlova.streaming import history as stream_history
from parlova.streaming.triage import read_triage_output, start_triage_stream

CONFIG = tr.TriageConfig(
    brand="brand_0",
    confidence_threshold=VIEW_THRESHOLD,
    min_grounding_score=VIEW_MIN_SCORE,
    high_risk_keywords=VIEW_RISKY,
)


def setup(spark, sf):
    """(golden, splits, model, index) of the standard flow."""
    golden_rows, splits = views.flow(spark, sf)
    index = retrieval.build_index(retrieval.index_corpus(splits))
    # The classifier and the index share one vocabulary and one set of weights.
    weights = index.semantic.withColumnRenamed("feature", "gram")
    model = classify.centroid_model_of(weights, index.corpus, index.vocabulary)
    return golden_rows, splits, model, index


def classifier(model):
    return lambda messages: classify.linear_probabilities(messages, model)


def _hits(spark, sf):
    _, splits, _, index = setup(spark, sf)
    messages = views.messages_of(splits)
    hits = retrieval.hybrid_topk(messages.select("qid", "text"), index, CONFIG.top_k)
    return messages, tr.fold_hits(retrieval.with_documents(hits, index.corpus, messages.select("qid", "intent")))


# The safe reply as SQL text.
_SAFE = sv.lit(tr.NO_EVIDENCE_REPLY)


def _define(p: str, source: str) -> None:
    _define_draft(p)
    _define_decision(f"{p}_triage_v", p, source)


def _define_draft(p: str) -> None:
    sv.define(
        f"{p}_draft_v",
        f"""SELECT t.qid, coalesce(s1, 0.0) AS top_score, CASE WHEN s1 >= {VIEW_MIN_SCORE} THEN r1 ELSE {_SAFE} END AS draft_reply,
  coalesce(s1 >= {VIEW_MIN_SCORE}, false) AS grounded,
  CASE WHEN s1 >= {VIEW_MIN_SCORE} THEN 'fallback_retrieval' ELSE 'fallback_no_evidence' END AS generation_mode,
  doc_ids, r1 FROM {p}_two_v t""",
    )


def _define_decision(name: str, p: str, source: str, repeated: str = "false", threshold: str = str(VIEW_THRESHOLD)) -> None:
    sv.define(
        name,
        f"""SELECT *, CASE WHEN reason_code IS NULL THEN 'AUTO_HANDLE' ELSE 'ESCALATE' END AS decision FROM (
  SELECT q.qid, q.message, i.intent, i.confidence, i.top_intents, d.draft_reply, d.grounded, d.generation_mode, d.doc_ids, d.top_score, d.r1,
    CASE WHEN i.intent = 'OTHER_OR_UNKNOWN' THEN 'UNKNOWN_INTENT'
      WHEN i.confidence < {threshold} THEN 'LOW_INTENT_CONFIDENCE'
      WHEN {sv.first_keyword('ct', policy.SENSITIVE_PHRASES)} IS NOT NULL THEN 'SENSITIVE_ACCOUNT_ACTION'
      WHEN {sv.first_keyword('ct', VIEW_RISKY)} IS NOT NULL THEN 'HIGH_RISK_REQUEST'
      WHEN {repeated} THEN 'REPEATED_FAILURE'
      WHEN c.conflicting THEN 'CONFLICTING_HISTORY'
      WHEN d.top_score < {VIEW_MIN_SCORE} THEN 'NO_RELEVANT_HISTORY'
      WHEN NOT d.grounded THEN 'UNSUPPORTED_INFORMATION' END AS reason_code
  FROM (SELECT *, {sv.clean('message')} AS ct FROM {source}) q
  JOIN {p}_intent_v i USING (qid) JOIN {p}_draft_v d USING (qid) JOIN {p}_conflict_v c USING (qid))""",
    )


_define("m", "messages_v")
_define("g", "golden_messages_v")


@query("conflicting_history", sql("SELECT qid, conflicting FROM m_conflict_v"))
def conflicting_history(spark, sf):
    return _hits(spark, sf)[1].select("qid", tr.conflicting_history(F.col("retrieved")).alias("conflicting"))


@query("draft_reply", sql("SELECT qid, md5(draft_reply) AS reply, grounded, generation_mode, round(CASE WHEN grounded THEN top_score ELSE 0.0 END, 6) AS confidence FROM m_draft_v"))
def draft_reply(spark, sf):
    rows = _hits(spark, sf)[1].select("qid", tr.draft_reply(F.col("retrieved"), VIEW_MIN_SCORE).alias("d"))
    return rows.select(
        "qid", F.md5("d.reply").alias("reply"), "d.grounded", "d.generation_mode", F.round("d.confidence", 6).alias("confidence")
    )


# Answers of an external model, well and badly formed, made from each message.
_ANSWERS = [
    ("0", '{"reply": "Reply <id>", "grounded": true, "confidence": 0.9, "unsupported_claims": [], "recommended_action": "AUTO_HANDLE", "escalation_reason": null}'),
    ("1", '```json\n{"reply": "Reply <id>", "grounded": false, "confidence": 0.4, "unsupported_claims": ["refund", "date"]}\n```'),
    ("2", 'Here it is: {"reply": "Reply <id>", "grounded": true, "confidence": 0.7} Thank you.'),
    ("3", '{"reply": "Reply <id>", "grounded": tru'),
    ("4", '{"reply": "", "grounded": true, "confidence": 0.2}'),
    ("5", '{"reply": "Reply <id>", "grounded": true} and {"reply": "other"}'),
]


def _answer(key):
    out = F.lit(None).cast("string")
    for n, text in _ANSWERS:
        out = F.when(key % 7 == int(n), F.regexp_replace(F.lit(text), "<id>", key.cast("string"))).otherwise(out)
    return out


_ANSWER_SQL = (
    "CASE key % 7 "
    + " ".join(f"WHEN {n} THEN replace({sv.lit(text)}, '<id>', CAST(key AS VARCHAR))" for n, text in _ANSWERS)
    + " END"
)
sv.define(
    "answers_v",
    f"SELECT conversation_id, key, {_ANSWER_SQL} AS raw FROM (SELECT conversation_id, pair_seq AS key FROM pairs_v)",
)
sv.define("m_answers_v", f"SELECT key AS qid, {_ANSWER_SQL} AS raw FROM (SELECT qid AS key FROM messages_v)")


def _define_parsed(name: str, source: str) -> None:
    sv.define(
        name,
        rf"""SELECT *, coalesce(try_cast(body AS JSON), try_cast(regexp_extract(body, '(?s)\{{.*\}}') AS JSON)) AS j FROM (
  SELECT *, CASE WHEN starts_with(trim(raw), '```') THEN
    CASE WHEN lower(left(trim(trim(raw), '`'), 4)) = 'json' THEN substr(trim(trim(raw), '`'), 5) ELSE trim(trim(raw), '`') END
    ELSE trim(raw) END AS body FROM {source})""",
    )


_define_parsed("parsed_v", "answers_v")
_define_parsed("m_parsed_v", "m_answers_v")


@query(
    "parse_model_payload",
    sql(
        f"""SELECT conversation_id, j IS NOT NULL AS parsed, j->>'$.reply' AS reply, coalesce(CAST(j->>'$.grounded' AS BOOLEAN), false) AS grounded,
  coalesce(CAST(j->>'$.confidence' AS DOUBLE), 0.0) AS confidence,
  CASE WHEN j IS NULL THEN '{PARSE_FAILURE_CLAIM}' ELSE coalesce(array_to_string(CAST(j->'$.unsupported_claims' AS VARCHAR[]), '|'), '') END AS claims,
  coalesce(j->>'$.recommended_action', 'ESCALATE') AS action FROM parsed_v"""
    ),
)
def parse_model_payload(spark, sf):
    rows = views.pairs(spark, sf).select("conversation_id", parse_payload(_answer(F.col("pair_seq"))).alias("p"))
    return rows.select(
        "conversation_id", "p.parsed", "p.reply", "p.grounded", "p.confidence",
        F.array_join("p.unsupported_claims", "|").alias("claims"), F.col("p.recommended_action").alias("action"),
    )


@query(
    "draft_from_responses",
    sql(
        """SELECT d.qid, CASE WHEN coalesce(p.j->>'$.reply', '') <> '' THEN p.j->>'$.reply' ELSE md5(d.draft_reply) END AS reply,
  CASE WHEN coalesce(p.j->>'$.reply', '') <> '' THEN 'llm' ELSE d.generation_mode END AS generation_mode,
  CASE WHEN coalesce(p.j->>'$.reply', '') <> '' THEN coalesce(CAST(p.j->>'$.grounded' AS BOOLEAN), false) ELSE d.grounded END AS grounded
FROM m_draft_v d LEFT JOIN m_parsed_v p USING (qid)"""
    ),
)
def draft_from_responses(spark, sf):
    rows = _hits(spark, sf)[1].select(
        "qid", tr.draft_from_response(_answer(F.col("qid")), F.col("retrieved"), VIEW_MIN_SCORE).alias("d")
    )
    reply = F.when(F.col("d.generation_mode") == "llm", F.col("d.reply")).otherwise(F.md5("d.reply"))
    return rows.select("qid", reply.alias("reply"), "d.generation_mode", "d.grounded")


_CASE_SQL = r"'* customer: ' || customer_text || chr(10) || '  reply: ' || support_reply || chr(10) || '  score: ' || printf('%.2f', score)"


@query(
    "prompt_table",
    sql(
        f"""SELECT q.qid, md5(concat_ws(chr(10), {sv.lit(tr.SYSTEM_TEXT)}, 'brand: brand_0', 'intent: ' || i.intent, 'message: ' || q.text, CASE WHEN q.qid % 2 = 0 THEN 'context: earlier turn ' || q.qid ELSE 'context: (none)' END, 'past cases:',
  coalesce(h.block, '(none)'), {sv.lit(tr.ANSWER_FORMAT)})) AS digest
FROM messages_v q JOIN m_intent_v i USING (qid)
LEFT JOIN (SELECT qid, string_agg({_CASE_SQL}, chr(10) ORDER BY rank) AS block FROM m_hits_v GROUP BY qid) h USING (qid)"""
    ),
)
def prompt_table(spark, sf):
    _, splits, model, index = setup(spark, sf)
    told = F.when(F.col("qid") % 2 == 0, F.concat(F.lit("earlier  turn "), F.col("qid").cast("string")))
    messages = views.messages_of(splits).select("qid", "message", told.alias("context"))
    prompts = tr.prompt_table(messages, classifier(model), model.classes, index, CONFIG)
    return prompts.select("qid", F.md5("prompt").alias("digest"))


def _triage_sql(view):
    return sql(
        f"""SELECT qid, md5(message) AS message, intent, round(confidence, 6) AS intent_confidence, top_intents, doc_ids, round(top_score, 6) AS top_score,
  md5(draft_reply) AS draft_reply, grounded, decision, reason_code, generation_mode FROM {view}"""
    )


# --- threads and earlier contacts ------------------------------------------------

sv.define(
    "linked_v",
    f"""SELECT tweet_id, inbound, text, ts_sec, ingest_seq, CASE WHEN conv % 11 = 0 AND turn = 0 THEN CAST(number + 3 AS VARCHAR)
  WHEN conv % 13 = 1 AND turn = 2 THEN tweet_id WHEN inbound AND turn > 0 THEN CAST(number - 1 AS VARCHAR)
  ELSE {sv.first_valid_id('in_response_to_tweet_id')} END AS named
FROM (SELECT *, CAST(tweet_id AS BIGINT) AS number, CAST(tweet_id AS BIGINT) // 1000 AS conv, CAST(tweet_id AS BIGINT) % 1000 AS turn FROM first_v)""",
)
sv.define(
    "edges_v",
    """SELECT a.tweet_id, b.tweet_id AS parent_id, a.inbound, a.text, a.ts_sec, a.ingest_seq,
  CASE WHEN a.named IS NULL THEN 'root' WHEN b.tweet_id IS NULL THEN 'missing' ELSE 'reply' END AS link
FROM linked_v a LEFT JOIN linked_v b ON b.tweet_id = a.named""",
)
sv.define(
    "cut_v",
    """WITH RECURSIVE reach AS (SELECT tweet_id, parent_id AS above FROM edges_v WHERE parent_id IS NOT NULL
  UNION SELECT r.tweet_id, e.parent_id FROM reach r JOIN edges_v e ON e.tweet_id = r.above WHERE e.parent_id IS NOT NULL)
SELECT tweet_id FROM reach GROUP BY tweet_id HAVING bool_or(above = tweet_id) AND min(above) = tweet_id""",
)
sv.define(
    "tree_v",
    """SELECT e.* REPLACE (CASE WHEN c.tweet_id IS NULL THEN parent_id END AS parent_id, CASE WHEN c.tweet_id IS NULL THEN link ELSE 'cut' END AS link)
FROM edges_v e LEFT JOIN cut_v c USING (tweet_id)""",
)
sv.define(
    "threads_v",
    """WITH RECURSIVE t AS (SELECT tweet_id, tweet_id AS root_id, 0 AS depth FROM tree_v WHERE parent_id IS NULL
  UNION ALL SELECT e.tweet_id, t.root_id, t.depth + 1 FROM t JOIN tree_v e ON e.parent_id = t.tweet_id)
SELECT * FROM t""",
)
sv.define(
    "turns_v",
    f"""WITH RECURSIVE t AS (SELECT tweet_id, parent_id, 1 AS back FROM tree_v WHERE parent_id IS NOT NULL
  UNION ALL SELECT t.tweet_id, e.parent_id, t.back + 1 FROM t JOIN tree_v e ON e.tweet_id = t.parent_id
  WHERE e.parent_id IS NOT NULL AND t.back < {thread_tree.CONTEXT_TURNS})
SELECT * FROM t""",
)
sv.define(
    "context_v",
    f"""SELECT e.tweet_id, coalesce(string_agg(CASE WHEN p.inbound THEN 'customer: ' ELSE 'support: ' END || {sv.clean('p.text')}, chr(10) ORDER BY t.back DESC) FILTER (p.tweet_id IS NOT NULL), '') AS context
FROM tree_v e LEFT JOIN turns_v t USING (tweet_id) LEFT JOIN tree_v p ON p.tweet_id = t.parent_id GROUP BY e.tweet_id""",
)


def _threads(spark, sf):
    tweets = views.linked_tweets(spark, sf)
    edges = materialize(thread_tree.reply_edges(tweets))
    return tweets, edges, materialize(thread_tree.thread_roots(edges))


@query(
    "thread_roots",
    sql(
        """SELECT tweet_id, t.root_id, CAST(t.depth AS BIGINT) AS depth, e.link,
  row_number() OVER (PARTITION BY t.root_id ORDER BY e.ts_sec NULLS LAST, e.ingest_seq) AS position
FROM threads_v t JOIN tree_v e USING (tweet_id)"""
    ),
)
def thread_roots(spark, sf):
    """Root, depth, place and kind of every message, circles of replies among them."""
    _, edges, roots = _threads(spark, sf)
    return roots.drop("path").join(thread_tree.thread_positions(roots, edges), "tweet_id")


@query("thread_context", sql("SELECT tweet_id, context FROM context_v"))
def thread_context(spark, sf):
    """The nearest earlier turns of every message."""
    tweets, _, roots = _threads(spark, sf)
    return thread_tree.thread_context(tweets, roots)


@query(
    "prompt_table_threads",
    sql(
        f"""SELECT q.qid, md5(concat_ws(chr(10), {sv.lit(tr.SYSTEM_TEXT)}, 'brand: brand_0', 'intent: ' || i.intent, 'message: ' || q.text,
  'context: ' || coalesce(nullif({sv.clean('c.context')}, ''), '(none)'), 'past cases:', coalesce(h.block, '(none)'), {sv.lit(tr.ANSWER_FORMAT)})) AS digest
FROM messages_v q JOIN splits_v s ON s.pair_seq = q.qid JOIN context_v c ON c.tweet_id = s.customer_tweet_id JOIN m_intent_v i USING (qid)
LEFT JOIN (SELECT qid, string_agg({_CASE_SQL}, chr(10) ORDER BY rank) AS block FROM m_hits_v GROUP BY qid) h USING (qid)"""
    ),
)
def prompt_table_threads(spark, sf):
    """Prompts of the test messages with the earlier turns of their threads."""
    _, splits, model, index = setup(spark, sf)
    tweets, _, roots = _threads(spark, sf)
    told = thread_tree.thread_context(tweets, roots).withColumnRenamed("tweet_id", "customer_tweet_id")
    messages = views.messages_of(splits).join(told, "customer_tweet_id", "left").select("qid", "message", "context")
    return tr.prompt_table(messages, classifier(model), model.classes, index, CONFIG).select("qid", F.md5("prompt").alias("digest"))


VIEW_FAILURE_DAYS = 30
sv.define(
    "contacts_v",
    f"""SELECT f.tweet_id, f.author_id AS customer, {sv.keyword_label(sv.clean('f.text'), views.VIEW_RULES)} AS intent, f.ts_sec AS opened,
  (SELECT min(s.ts_sec) FROM support_v s WHERE s.target_id = f.tweet_id) AS resolved, f.ingest_seq AS seq FROM first_v f WHERE f.inbound""",
)
sv.define(
    "repeated_v",
    f"""SELECT m.tweet_id, m.seq AS qid, EXISTS (SELECT 1 FROM contacts_v c WHERE c.customer = m.customer AND c.intent = m.intent
  AND c.intent <> 'OTHER_OR_UNKNOWN' AND (c.opened < m.opened OR (c.opened = m.opened AND c.seq < m.seq))
  AND m.opened <= c.opened + {VIEW_FAILURE_DAYS * 86400} AND (c.resolved IS NULL OR c.resolved > m.opened)) AS repeated_failure
FROM contacts_v m""",
)
_define_decision("mr_triage_v", "m", "(SELECT q.*, r.repeated_failure FROM messages_v q JOIN splits_v s ON s.pair_seq = q.qid JOIN repeated_v r ON r.tweet_id = s.customer_tweet_id)", "q.repeated_failure")


def _repeated(spark, sf):
    found = materialize(history.contacts(views.tweets(spark, sf), weak_label(clean_text(F.col("text")), views.VIEW_RULES)))
    asked = found.select(F.col("seq").alias("qid"), "customer", "intent", F.col("opened").alias("sent"), "seq")
    flags = history.repeated_failures(asked, found, VIEW_FAILURE_DAYS)
    return found.select("tweet_id", F.col("seq").alias("qid")).join(flags, "qid")


@query("repeated_failure", sql("SELECT qid, repeated_failure FROM repeated_v"))
def repeated_failure(spark, sf):
    """Which customer messages come back to an issue of the last 30 days that is still open."""
    return _repeated(spark, sf).select("qid", "repeated_failure")


@query("repeated_failure_stream", sql("SELECT qid, repeated_failure FROM repeated_v"))
def repeated_failure_stream(spark, sf):
    """As ``repeated_failure``, from a replay of messages and replies as a stream."""
    tweets = views.tweets(spark, sf)
    found = materialize(history.contacts(tweets, weak_label(clean_text(F.col("text")), views.VIEW_RULES)))
    messages = found.select("customer", "tweet_id", "intent", F.col("opened").alias("at"), "seq", F.lit(None).cast("string").alias("answers"))
    replies = tweets.where("NOT inbound").select(
        F.concat(F.lit("reply_"), F.col("ingest_seq").cast("string")).alias("reply_id"),
        F.col("created_at_parsed").alias("at"),
        F.col("ingest_seq").alias("seq"),
        first_valid_id(F.col("in_response_to_tweet_id")).alias("answers"),
    )
    named = found.select("customer", F.col("tweet_id").alias("answers"))
    replies = replies.join(named, "answers").select(
        "customer", F.col("reply_id").alias("tweet_id"), F.lit(None).cast("string").alias("intent"), "at", "seq", "answers"
    )
    # An event far ahead, so that the watermark passes all others.
    end = F.lit("2200-01-01").cast("timestamp")
    last = spark.range(1).select(
        F.lit("").alias("customer"), F.lit("").alias("tweet_id"), F.lit(None).cast("string").alias("intent"), end.alias("at"),
        F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("answers"),
    )
    source, output = scratch_path(spark, "events"), scratch_path(spark, "flags")
    messages.unionByName(replies).unionByName(last).write.parquet(source)
    # The files of a replay come in any order: nothing is late before its end.
    flags = stream_history.repeated_failure_stream(
        spark.readStream.schema(stream_history.EVENT_SCHEMA).parquet(source), VIEW_FAILURE_DAYS, "100 days"
    )
    writer = flags.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "stream")).option("path", output)
    writer.trigger(availableNow=True).start().awaitTermination()
    flagged = spark.read.schema(flags.schema).parquet(output).select("tweet_id", "repeated_failure")
    return found.join(flagged, "tweet_id", "left").select(
        F.col("seq").alias("qid"), F.coalesce("repeated_failure", F.lit(False)).alias("repeated_failure")
    )


_CHOSEN = "coalesce((SELECT threshold FROM chosen_v), 2.0)"
sv.define("mc_intent_v", f"SELECT * REPLACE (CASE WHEN confidence < {_CHOSEN} THEN 'OTHER_OR_UNKNOWN' ELSE best_intent END AS intent) FROM m_intent_v")
sv.define("mc_draft_v", "SELECT * FROM m_draft_v")
sv.define("mc_conflict_v", "SELECT * FROM m_conflict_v")
_define_decision("mc_triage_v", "mc", "messages_v", threshold=_CHOSEN)


@query("triage_chosen_threshold", _triage_sql("mc_triage_v"))
def triage_chosen_threshold(spark, sf):
    """Triage of the test messages at the threshold that the validation split proves."""
    _, splits, model, index = setup(spark, sf)
    held_out = views.messages_of(splits, "val")
    scored = classify.with_intent(classify.linear_probabilities(held_out.select("qid", "text"), model), model.classes, 0.0)
    predicted = scored.join(held_out.select("qid", F.col("intent").alias("true_intent")), "qid")
    config = replace(CONFIG, confidence_threshold=classify.choose_threshold(predicted, VIEW_TARGET))
    messages = views.messages_of(splits).select("qid", "message")
    return flat(tr.triage(messages, classifier(model), model.classes, index, config))


@query("triage_with_history", _triage_sql("mr_triage_v"))
def triage_with_history(spark, sf):
    """Triage of the test messages, told which of them are repeated failures."""
    _, splits, model, index = setup(spark, sf)
    flags = _repeated(spark, sf).select(F.col("tweet_id").alias("customer_tweet_id"), "repeated_failure")
    messages = views.messages_of(splits).join(flags, "customer_tweet_id", "left").select("qid", "message", "repeated_failure")
    return flat(tr.triage(messages, classifier(model), model.classes, index, CONFIG))


# --- policy ----------------------------------------------------------------------

# Signals of every message, spread so that each rule decides for some of them.
_MIX = views.MIXED_SQL
_SIGNALS = {
    "signal_intent": f"CASE WHEN {_MIX} % 9 = 0 THEN 'OTHER_OR_UNKNOWN' ELSE intent END",
    "confidence": f"({_MIX} % 100) / 100.0::DOUBLE",
    "top_score": f"({_MIX} % 37) / 37.0::DOUBLE",
    "grounded": f"{_MIX} % 8 <> 0",
    "conflicting": f"{_MIX} % 10 = 0",
    "repeated": f"{_MIX} % 12 = 0",
}
sv.define(
    "decided_v",
    f"""SELECT conversation_id, CASE WHEN signal_intent = 'OTHER_OR_UNKNOWN' THEN 'UNKNOWN_INTENT'
  WHEN confidence < 0.3 THEN 'LOW_INTENT_CONFIDENCE'
  WHEN {sv.first_keyword('cleaned_text', views.VIEW_SENSITIVE)} IS NOT NULL THEN 'SENSITIVE_ACCOUNT_ACTION'
  WHEN {sv.first_keyword('cleaned_text', VIEW_RISKY)} IS NOT NULL THEN 'HIGH_RISK_REQUEST'
  WHEN repeated THEN 'REPEATED_FAILURE' WHEN conflicting THEN 'CONFLICTING_HISTORY'
  WHEN top_score < 0.35 THEN 'NO_RELEVANT_HISTORY'
  WHEN NOT grounded OR claims THEN 'UNSUPPORTED_INFORMATION' END AS reason_code
FROM (SELECT *, {_MIX} % 11 = 0 AS claims, {', '.join(f'{v} AS {k}' for k, v in _SIGNALS.items())} FROM pairs_v)""",
)


def _decided(spark, sf):
    seq = views.mixed(F.col("pair_seq"))
    out = policy.escalation_decision(
        F.col("cleaned_text"),
        F.when(seq % 9 == 0, "OTHER_OR_UNKNOWN").otherwise(F.col("intent")),
        (seq % 100) / 100.0,
        (seq % 37) / 37.0,
        seq % 8 != 0,
        F.when(seq % 11 == 0, F.array(F.lit("amount"))).otherwise(F.array().cast("array<string>")),
        seq % 10 == 0,
        seq % 12 == 0,
        confidence_threshold=0.3,
        high_risk_keywords=VIEW_RISKY,
        sensitive_phrases=views.VIEW_SENSITIVE,
    )
    return views.pairs(spark, sf).select("conversation_id", out.alias("o")).select("conversation_id", "o.*")


_DECISION = "CASE WHEN reason_code IS NULL THEN 'AUTO_HANDLE' ELSE 'ESCALATE' END AS decision"


@query("escalation_policy", sql(f"SELECT conversation_id, {_DECISION}, reason_code FROM decided_v"))
def escalation_policy(spark, sf):
    return _decided(spark, sf).select("conversation_id", "decision", "reason_code")


@query(
    "escalation_policy_missing_signals",
    sql(
        """SELECT conversation_id, CASE WHEN pair_seq % 2 = 0 OR pair_seq % 3 < 2 OR pair_seq % 5 < 2 OR pair_seq % 7 = 0 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS decision,
  CASE WHEN pair_seq % 2 = 0 THEN 'UNKNOWN_INTENT' WHEN pair_seq % 3 < 2 THEN 'LOW_INTENT_CONFIDENCE' WHEN pair_seq % 5 < 2 THEN 'NO_RELEVANT_HISTORY'
    WHEN pair_seq % 7 = 0 THEN 'UNSUPPORTED_INFORMATION' END AS reason_code FROM pairs_v"""
    ),
)
def escalation_policy_missing_signals(spark, sf):
    """Null and NaN signals, each of which must escalate."""
    seq = F.col("pair_seq")

    def gap(n, value):
        return F.when(seq % n == 0, F.lit(None).cast("double")).when(seq % n == 1, F.lit(float("nan"))).otherwise(value)

    out = policy.escalation_decision(
        F.lit(None).cast("string"),
        F.when(seq % 2 != 0, "REFUND_REQUEST"),
        gap(3, 0.9),
        gap(5, 0.9),
        F.when(seq % 7 != 0, F.lit(True)),
        F.lit(None).cast("array<string>"),
        F.lit(None).cast("boolean"),
    )
    return views.pairs(spark, sf).select("conversation_id", out.alias("o")).select("conversation_id", "o.decision", "o.reason_code")


@query("reason_code_counts", sql(f"SELECT {_DECISION}, reason_code, count(*) AS n FROM decided_v GROUP BY reason_code"))
def reason_code_counts(spark, sf):
    return policy.reason_code_counts(_decided(spark, sf))


# --- triage ----------------------------------------------------------------------

def flat(rows):
    first = F.get("retrieved_examples", F.lit(0))["score"]
    return rows.select(
        "qid",
        F.md5("customer_message").alias("message"),
        "intent",
        F.round("intent_confidence", 6).alias("intent_confidence"),
        F.array_join(F.transform("top_intents", lambda t: t["intent"]), "|").alias("top_intents"),
        F.array_join(F.transform("retrieved_examples", lambda r: r["doc_id"].cast("string")), "|").alias("doc_ids"),
        F.round(F.coalesce(first, F.lit(0.0)), 6).alias("top_score"),
        F.md5("draft_reply").alias("draft_reply"),
        "grounded",
        "decision",
        "reason_code",
        "generation_mode",
    )


def _triaged(spark, sf):
    _, splits, model, index = setup(spark, sf)
    messages = views.messages_of(splits).select("qid", "message")
    return tr.triage(messages, classifier(model), model.classes, index, CONFIG)


@query("triage_messages", _triage_sql("m_triage_v"))
def triage_messages(spark, sf):
    return flat(_triaged(spark, sf))


@query(
    "response_schema_violations",
    sql(
        """SELECT count(*) AS n_rows, count(*) FILTER (qid % 3 = 0) AS n_bad_confidence, count(*) FILTER (qid % 5 = 0) AS n_missing_reply,
  count(*) FILTER (qid % 7 = 0) AS n_bad_decision FROM m_triage_v WHERE confidence BETWEEN 0 AND 1"""
    ),
)
def response_schema_violations(spark, sf):
    """Contract breaks of responses, some of them planted."""
    q = F.col("qid")
    bad = F.when(q % 2 == 0, F.lit(1.5)).when(q % 9 == 0, F.lit(float("nan")))
    return tr.response_violations(
        _triaged(spark, sf).withColumns(
            {
                "intent_confidence": F.when(q % 3 == 0, bad).otherwise(F.col("intent_confidence")),
                "draft_reply": F.when(q % 5 != 0, F.col("draft_reply")),
                "decision": F.when(q % 7 == 0, F.when(q % 2 == 0, "MAYBE")).otherwise(F.col("decision")),
            }
        )
    )


@query("triage_stream", _triage_sql("m_triage_v"))
def triage_stream(spark, sf):
    """The same messages, arriving as files."""
    _, splits, model, index = setup(spark, sf)
    source, out = scratch_path(spark, "messages"), scratch_path(spark, "responses")
    views.messages_of(splits).select("qid", "message").repartition(2).write.parquet(source)
    stream = start_triage_stream(
        spark, source, out, scratch_path(spark, "stream"), classifier(model), model.classes, index, CONFIG, files_per_batch=1
    )
    stream.awaitTermination()
    return flat(read_triage_output(spark, out))


@query("triage_trained")
def triage_trained(spark, sf):
    """Triage with a trained, calibrated classifier."""
    _, splits = views.flow(spark, sf)
    index = retrieval.build_index(retrieval.index_corpus(splits))
    model = classify.train_calibrated(views.training_rows(splits))
    messages = views.messages_of(splits).select("qid", "message")
    return flat(materialize(tr.triage(messages, model.probabilities, model.classes, index, CONFIG)))


@query(
    "triage_trained_checks",
    sql("SELECT count(*) AS n_rows, 0 AS n_bad_confidence, 0 AS n_missing_reply, 0 AS n_bad_decision FROM messages_v"),
)
def triage_trained_checks(spark, sf):
    """Every message gets a response that keeps the contract."""
    _, splits = views.flow(spark, sf)
    index = retrieval.build_index(retrieval.index_corpus(splits))
    model = classify.train_calibrated(views.training_rows(splits))
    messages = views.messages_of(splits).select("qid", "message")
    return tr.response_violations(tr.triage(messages, model.probabilities, model.classes, index, CONFIG))
