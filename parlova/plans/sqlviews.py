"""The views of ``sources.views`` and shared steps, as SQL common table expressions."""

from __future__ import annotations

import re

from parlova.functions.text import EMAIL_PATTERN, MENTION_PATTERN, RETRIEVAL_TOKEN, SPACE, URL_PATTERN, WORD
from parlova.sources.views import BASE_SECONDS, GOLDEN_SHARE, VIEW_RULES

# The same pattern without lookarounds, which this engine's regexes lack.
PHONE_SQL = rf"\b\+?\d[\d\-{SPACE}()]{{7,}}\d\b"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replace(expr: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(by)}, 'g')"


def mask_emails(expr: str) -> str:
    return replace(expr, EMAIL_PATTERN, "[EMAIL]")


def mask_phones(expr: str) -> str:
    return replace(expr, PHONE_SQL, "[PHONE]")


def mask_pii(expr: str) -> str:
    return mask_phones(mask_emails(expr))


def clean(expr: str, keep_mentions: bool = False, mask_first: bool = False) -> str:
    out = replace(f"coalesce({expr}, '')", URL_PATTERN)
    if mask_first:
        out = mask_pii(out)
    if not keep_mentions:
        out = replace(out, MENTION_PATTERN)
    if not mask_first:
        out = mask_pii(out)
    return f"trim({replace(out, f'[{SPACE}]+', ' ')})"


def space_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {lit(f'[{SPACE}]+')}), lambda t: t <> '')"


def token_count(expr: str) -> str:
    return f"len({space_tokens(expr)})"


def bucket(expr: str) -> str:
    n = token_count(expr)
    return f"CASE WHEN {n} <= 4 THEN 'short' WHEN {n} <= 15 THEN 'medium' ELSE 'long' END"


def retrieval_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {lit(RETRIEVAL_TOKEN)})"


def vector_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {lit(f'[{WORD}]{{2,}}')})"


def grams(tokens: str) -> str:
    return f"list_concat({tokens}, list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1]))"


def keyword_label(expr: str, rules, default: str = "OTHER_OR_UNKNOWN") -> str:
    arms = []
    for label, words in rules:
        hit = " OR ".join(f"contains(lower({expr}), {lit(w)})" for w in words)
        arms.append(f"WHEN {hit} THEN {lit(label)}")
    return f"CASE {' '.join(arms)} ELSE {lit(default)} END"


def first_keyword(expr: str, words) -> str:
    arms = " ".join(f"WHEN contains(lower({expr}), {lit(w.lower())}) THEN {lit(w)}" for w in words)
    return f"CASE {arms} END" if words else "NULL"


def first_valid_id(expr: str) -> str:
    return f"CASE WHEN lower(trim({expr})) <> 'nan' THEN nullif(trim(split_part(trim({expr}), ',', 1)), '') END"


_V: dict[str, str] = {}

_V["raw_tweets_v"] = f"""
SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS tweet_id,
  CASE WHEN copy = 1 THEN 'cust_copy' WHEN role = 'user' THEN 'cust_' || CAST(conv_id % 97 AS VARCHAR)
       WHEN role = 'assistant' THEN 'brand_' || CAST(conv_id % 3 AS VARCHAR) ELSE 'system' END AS author_id,
  CASE WHEN role = 'user' THEN ['True', ' TRUE ', 'true'][conv_id % 3 + 1] WHEN role = 'system' THEN 'no' ELSE 'False' END AS inbound,
  CASE WHEN conv_id % 53 = 0 THEN 'not a date' ELSE strftime(make_timestamp(ts * 1000000), '%a %b %d %H:%M:%S +0000 %Y') END AS created_at,
  text,
  CASE WHEN role = 'user' THEN CAST(conv_id * 1000 + turn + 1 AS VARCHAR) END AS response_tweet_id,
  CASE WHEN role = 'assistant' THEN
    CASE WHEN (conv_id * 7 + turn) % 41 = 0 THEN ''
         WHEN (conv_id * 7 + turn) % 50 = 0 THEN CAST(conv_id * 1000 + turn - 1 AS VARCHAR) || ',999999'
         WHEN (conv_id * 7 + turn) % 61 = 0 THEN 'nan'
         WHEN (conv_id * 7 + turn) % 67 = 0 THEN '77'
         ELSE CAST(conv_id * 1000 + turn - 1 AS VARCHAR) END END AS in_response_to_tweet_id,
  conv_id * 1000 + turn + copy * 1000000000000000 AS ingest_seq
FROM (SELECT *, {BASE_SECONDS} + ((conv_id * 37) % 1000) * 3600 + turn * 60 AS ts,
        unnest(CASE WHEN role = 'user' AND conv_id % 29 = 0 THEN [0, 1] ELSE [0] END) AS copy
      FROM conversations)"""

_V["tweets_v"] = """
SELECT tweet_id, author_id, lower(trim(inbound)) = 'true' AS inbound, created_at, text, response_tweet_id,
  in_response_to_tweet_id, ingest_seq,
  CAST(epoch(try_strptime(created_at[5:], '%b %d %H:%M:%S +0000 %Y')) AS BIGINT) AS ts_sec
FROM raw_tweets_v"""

_V["first_v"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY ingest_seq) AS rn FROM tweets_v) WHERE rn = 1"""

_V["support_v"] = f"""
SELECT tweet_id AS support_tweet_id, text AS support_text, ts_sec, author_id AS support_author, ingest_seq AS pair_seq,
  {first_valid_id('in_response_to_tweet_id')} AS target_id
FROM tweets_v WHERE NOT inbound"""

_V["pairs_v"] = f"""
SELECT f.tweet_id || '__' || s.support_tweet_id AS conversation_id, f.tweet_id AS customer_tweet_id,
  f.text AS customer_text, s.support_tweet_id, s.support_text, s.ts_sec, f.author_id AS customer_author,
  s.support_author, s.pair_seq, {clean('f.text')} AS cleaned_text,
  {keyword_label(clean('f.text'), VIEW_RULES)} AS intent
FROM support_v s JOIN first_v f ON f.tweet_id = s.target_id WHERE f.inbound"""

_V["dedup_v"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cleaned_text ORDER BY pair_seq) AS rn FROM pairs_v) WHERE rn = 1"""

_V["timed_v"] = """
SELECT *, row_number() OVER (ORDER BY ts_sec, pair_seq) AS r, count(*) OVER () AS n FROM dedup_v WHERE ts_sec IS NOT NULL"""

_V["strata_v"] = f"""
SELECT *, {bucket('cleaned_text')} AS length_bucket,
  CASE WHEN n <= 1 THEN 1 ELSE greatest(1, CAST(ceil((r - 1) * 4 / CAST(n - 1 AS DOUBLE)) AS BIGINT)) END AS time_quartile
FROM timed_v"""


def _sample(target: int | str, prefix: str) -> dict[str, str]:
    order = "md5(conversation_id || '#42'), conversation_id"
    return {
        f"{prefix}_picked_v": f"""
SELECT conversation_id, length_bucket, time_quartile FROM (
  SELECT *, row_number() OVER (PARTITION BY length_bucket, time_quartile ORDER BY {order}) AS rk FROM strata_v)
WHERE rk <= greatest(1, {target} // (SELECT count(*) FROM (SELECT DISTINCT length_bucket, time_quartile FROM strata_v)))""",
        f"{prefix}_topup_v": f"""
SELECT conversation_id FROM (SELECT conversation_id, row_number() OVER (ORDER BY {order}) AS rk FROM dedup_v
  WHERE conversation_id NOT IN (SELECT conversation_id FROM {prefix}_picked_v))
WHERE rk <= {target} - (SELECT count(*) FROM {prefix}_picked_v)""",
        f"{prefix}_sample_v": f"""
SELECT * FROM (SELECT conversation_id, row_number() OVER (ORDER BY md5(conversation_id || '#43'), conversation_id) AS rk
  FROM (SELECT conversation_id FROM {prefix}_picked_v UNION ALL SELECT conversation_id FROM {prefix}_topup_v))
WHERE rk <= {target}""",
    }


_V.update(_sample(f"(SELECT count(*) FROM pairs_v) // {GOLDEN_SHARE}", "small"))
_V.update(_sample(200, "full"))

_V["golden_v"] = """
SELECT printf('golden_%04d', s.rk - 1) AS example_id, d.cleaned_text AS customer_text, d.customer_text AS context,
  d.pair_seq AS qid,
  CASE WHEN pair_seq % 11 = 0 THEN NULL WHEN pair_seq % 17 = 0 THEN 'BOGUS_INTENT' ELSE intent END AS gold_intent,
  CASE WHEN pair_seq % 13 = 0 THEN NULL WHEN pair_seq % 19 = 0 THEN 'MAYBE' WHEN pair_seq % 3 = 0 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS gold_escalate,
  CASE WHEN pair_seq % 13 <> 0 AND pair_seq % 19 <> 0 AND pair_seq % 3 = 0 THEN
    CASE WHEN pair_seq % 5 = 0 THEN NULL WHEN pair_seq % 7 = 0 THEN 'BOGUS_CODE' ELSE 'HIGH_RISK_REQUEST' END END AS gold_escalation_reason
FROM small_sample_v s JOIN dedup_v d USING (conversation_id)"""

_V["splits_v"] = """
SELECT *, CASE WHEN time_rank <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
  WHEN time_rank <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY ts_sec, pair_seq) AS time_rank, count(*) OVER () AS n FROM pairs_v
      WHERE ts_sec IS NOT NULL AND cleaned_text NOT IN (SELECT customer_text FROM golden_v))"""

_V["corpus_v"] = """
SELECT pair_seq AS doc_id, cleaned_text AS customer_text, support_text AS support_reply, intent
FROM splits_v WHERE split = 'train' AND cleaned_text IS NOT NULL AND support_text IS NOT NULL"""

_V["messages_v"] = """
SELECT pair_seq AS qid, customer_text AS message, cleaned_text AS text, intent FROM splits_v WHERE split = 'test'"""

_V["golden_complete_v"] = "SELECT * FROM golden_v WHERE gold_intent IS NOT NULL AND gold_escalate IS NOT NULL"

_V["golden_messages_v"] = "SELECT qid, customer_text AS message, customer_text AS text FROM golden_complete_v"

_V["postings_v"] = f"""
SELECT term, doc_id, count(*) AS tf, any_value(doc_len) AS doc_len FROM (
  SELECT doc_id, len(t) AS doc_len, unnest(t) AS term FROM (SELECT doc_id, {retrieval_tokens('customer_text')} AS t FROM corpus_v))
GROUP BY term, doc_id"""

_V["doc_stats_v"] = f"SELECT doc_id, len({retrieval_tokens('customer_text')}) AS doc_len FROM corpus_v"

_V["term_idf_v"] = """
SELECT term, count(*) AS df, ln(((SELECT count(*) FROM doc_stats_v) - count(*) + 0.5) / (count(*) + 0.5) + 1.0) AS idf
FROM postings_v GROUP BY term"""

_V["bm25_weights_v"] = """
SELECT p.term, p.doc_id, i.idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / (SELECT avg(doc_len) FROM doc_stats_v))) AS w
FROM postings_v p JOIN term_idf_v i USING (term)"""

_V["doc_grams_v"] = f"""
SELECT doc_id, gram, count(*) AS tf FROM (
  SELECT doc_id, unnest({grams('t')}) AS gram FROM (SELECT doc_id, {vector_tokens('customer_text')} AS t FROM corpus_v))
GROUP BY doc_id, gram"""

_V["vocab_v"] = """
SELECT gram, df, ln(((SELECT count(*) FROM corpus_v) + 1.0) / (df + 1.0)) + 1.0 AS idf
FROM (SELECT gram, sum(tf) AS total, count(*) AS df FROM doc_grams_v GROUP BY gram ORDER BY total DESC, gram LIMIT 5000)"""

_V["doc_tfidf_v"] = """
SELECT doc_id, gram, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w
FROM (SELECT doc_id, gram, tf * idf AS x FROM doc_grams_v JOIN vocab_v USING (gram))"""

_V["class_sizes_v"] = "SELECT intent, count(*) AS n FROM corpus_v GROUP BY intent"

_V["coefs_v"] = """
SELECT c.intent AS class, w.gram, sum(w.w) / any_value(s.n) AS coef
FROM doc_tfidf_v w JOIN corpus_v c USING (doc_id) JOIN class_sizes_v s ON s.intent = c.intent
GROUP BY c.intent, w.gram"""


def _per_query(source: str, p: str, threshold: float, k: int = 5) -> dict[str, str]:
    """Classification and retrieval of the messages in ``source``."""
    return {
        f"{p}_lexq_v": f"""
SELECT qid, term, count(*) AS qw FROM (SELECT qid, unnest({retrieval_tokens('text')}) AS term FROM {source}) GROUP BY qid, term""",
        f"{p}_lex_v": f"SELECT qid, doc_id, sum(qw * w) AS score FROM {p}_lexq_v JOIN bm25_weights_v USING (term) GROUP BY qid, doc_id",
        f"{p}_semq_v": f"""
SELECT qid, gram, x / sqrt(sum(x * x) OVER (PARTITION BY qid)) AS qw FROM (
  SELECT qid, gram, count(*) * any_value(idf) AS x
  FROM (SELECT qid, unnest({grams('t')}) AS gram FROM (SELECT qid, {vector_tokens('text')} AS t FROM {source}))
  JOIN vocab_v USING (gram) GROUP BY qid, gram)""",
        f"{p}_sem_v": f"SELECT qid, doc_id, sum(qw * w) AS score FROM {p}_semq_v JOIN doc_tfidf_v USING (gram) GROUP BY qid, doc_id",
        f"{p}_probs_v": f"""
SELECT qid, class, exp(10.0 * dot - m) / sum(exp(10.0 * dot - m)) OVER (PARTITION BY qid) AS prob FROM (
  SELECT qid, class, dot, max(10.0 * dot) OVER (PARTITION BY qid) AS m FROM (
    SELECT q.qid, c.intent AS class, coalesce(d.dot, 0.0) AS dot
    FROM (SELECT qid FROM {source}) q CROSS JOIN class_sizes_v c
    LEFT JOIN (SELECT qid, class, sum(qw * coef) AS dot FROM {p}_semq_v JOIN coefs_v USING (gram) GROUP BY qid, class) d
      ON d.qid = q.qid AND d.class = c.intent))""",
        f"{p}_ranked_v": f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(prob, 9) DESC, class) AS rk FROM {p}_probs_v",
        f"{p}_intent_v": f"""
SELECT qid, max(CASE WHEN rk = 1 THEN class END) AS best_intent, max(CASE WHEN rk = 1 THEN prob END) AS confidence,
  CASE WHEN max(CASE WHEN rk = 1 THEN prob END) < {threshold} THEN 'OTHER_OR_UNKNOWN' ELSE max(CASE WHEN rk = 1 THEN class END) END AS intent,
  string_agg(class, '|' ORDER BY rk) FILTER (rk <= 3) AS top_intents,
  max(CASE WHEN rk = 2 THEN prob END) AS second, max(CASE WHEN rk = 3 THEN prob END) AS third
FROM {p}_ranked_v GROUP BY qid""",
        f"{p}_hybrid_v": f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
    SELECT q.qid, c.doc_id, coalesce(l.score / l.best, 0.0) AS lexical_score, coalesce(s.score, 0.0) AS semantic_score,
      0.4::DOUBLE * coalesce(l.score / l.best, 0.0) + 0.6::DOUBLE * coalesce(s.score, 0.0) AS score
    FROM (SELECT qid FROM {source}) q CROSS JOIN corpus_v c
    LEFT JOIN (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM {p}_lex_v) l ON l.qid = q.qid AND l.doc_id = c.doc_id
    LEFT JOIN {p}_sem_v s ON s.qid = q.qid AND s.doc_id = c.doc_id))
WHERE rank <= {k}""",
        f"{p}_hits_v": f"""
SELECT h.*, c.customer_text, c.support_reply, c.intent AS doc_intent FROM {p}_hybrid_v h JOIN corpus_v c USING (doc_id)""",
        f"{p}_two_v": f"""
SELECT qid, max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2,
  max(CASE WHEN rank = 1 THEN support_reply END) AS r1, max(CASE WHEN rank = 2 THEN support_reply END) AS r2,
  string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY rank) AS doc_ids
FROM {p}_hits_v GROUP BY qid""",
        f"{p}_conflict_v": f"""
SELECT qid, coalesce(abs(s1 - s2) <= 0.15 AND len(a) > 0 AND len(b) > 0
  AND len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) < 0.05, false) AS conflicting
FROM (SELECT qid, s1, s2, list_distinct({space_tokens('lower(r1)')}) AS a, list_distinct({space_tokens('lower(r2)')}) AS b FROM {p}_two_v)""",
    }


VIEW_THRESHOLD = 0.25
VIEW_MIN_SCORE = 0.5
_V.update(_per_query("messages_v", "m", VIEW_THRESHOLD))
_V.update(_per_query("golden_messages_v", "g", VIEW_THRESHOLD))

_V["vectors_v"] = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings"

_V["centroids_v"] = """
SELECT label, pos, avg(x) AS mean FROM (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM vectors_v)
GROUP BY label, pos"""

_V["centroid_vectors_v"] = "SELECT label, list(mean ORDER BY pos) AS centroid FROM centroids_v GROUP BY label"

_V["predicted_v"] = """
SELECT vec_id, label, predicted FROM (
  SELECT v.vec_id, v.label, c.label AS predicted,
    row_number() OVER (PARTITION BY v.vec_id ORDER BY round(pow(list_distance(v.vec, c.centroid), 2), 9), c.label) AS rk
  FROM vectors_v v CROSS JOIN centroid_vectors_v c) WHERE rk = 1"""


def _rating(side: str) -> str:
    base = {
        "groundedness": "1 + doc_id % 5",
        "relevance": "1 + (doc_id * 3 + quality) % 5",
        "correctness": "CASE WHEN doc_id % 4 = 0 THEN 5 ELSE 2 + quality END",
        "helpfulness": "1 + (doc_id + toxic) % 2 * 3",
        "tone": "4",
        "overall": "1 + (doc_id * 7) % 4",
    }
    if side == "human":
        cols = ", ".join(f"{v} AS {n}" for n, v in base.items())
        return f"SELECT CAST(doc_id AS VARCHAR) AS example_id, {cols} FROM labels"
    shift = {"groundedness": 3, "relevance": 4, "correctness": 5, "helpfulness": 2, "tone": 6, "overall": 7}
    cols = ", ".join(
        f"CASE WHEN doc_id % 9 <> 0 THEN CASE WHEN doc_id % {shift[n]} = 0 THEN least({v} + 1, 5) ELSE {v} END END AS {n}"
        for n, v in base.items()
    )
    return f"SELECT CAST(doc_id AS VARCHAR) AS example_id, CASE WHEN doc_id % 9 = 0 THEN 'error' ELSE 'ok' END AS status, {cols} FROM labels"


_V["judge_v"] = _rating("judge")
_V["human_v"] = _rating("human")


def define(name: str, body: str) -> None:
    _V[name] = body


def sql(final: str) -> str:
    """``final`` preceded by every view it needs, in order of use."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z0-9_]+_v\b", text):
            if name in _V and name not in ordered:
                visit(_V[name])
                if name not in ordered:
                    ordered.append(name)

    visit(final)
    if not ordered:
        return final.strip()
    parts = ",\n".join(f"{n} AS MATERIALIZED ({_V[n].strip()})" for n in ordered)
    return f"WITH {parts}\n{final.strip()}"
