"""Queries on sources, text, profile, accounts, pairs, splits, golden set and leakage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlova.functions import text as tx
from parlova.functions.ids import first_valid_id, parse_created_at
from parlova.operators import brands, day_profile, golden, leakage, profile, ranking, sampling, threads
from parlova.operators.vectors import gram_counts
from parlova.plans import sqlviews as sv
from parlova.plans.registry import query
from parlova.plans.sqlviews import sql
from parlova.runtime import materialize, scratch_path
from parlova.schemas import INTENTS, REASON_CODES, intent_dimension
from parlova.sources import tables, views
from parlova.sources.tweets import limited, read_tweets_csv, write_tweets_csv


def _secs(col: str):
    return F.unix_seconds(F.col(col))


# --- sources -----------------------------------------------------------------


@query("scan_row_cap", "SELECT * FROM conversations ORDER BY conv_id, turn LIMIT 100")
def scan_row_cap(spark, sf):
    return limited(views.table(spark, sf, "conversations"), ["conv_id", "turn"], 100)


@query("scan_tweets_csv", sql("SELECT author_id, count(*) AS n, sum(length(text)) AS n_chars, count(nullif(in_response_to_tweet_id, '')) AS n_replies FROM raw_tweets_v GROUP BY author_id"))
def scan_tweets_csv(spark, sf):
    """Write the messages as CSV, scan them back, and sum up what was read."""
    path = write_tweets_csv(views.raw_tweets(spark, sf).drop("ingest_seq"), scratch_path(spark, "tweets-csv"))
    return read_tweets_csv(spark, path).groupBy("author_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("text")).alias("n_chars"),
        F.count("in_response_to_tweet_id").alias("n_replies"),
    )


@query("normalize_inbound", sql("SELECT inbound, count(*) AS n FROM tweets_v GROUP BY inbound"))
def normalize_inbound(spark, sf):
    return views.tweets(spark, sf).groupBy("inbound").agg(F.count(F.lit(1)).alias("n"))


@query(
    "parse_created_at",
    """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""",
)
def parse_created_at_query(spark, sf):
    ts = F.col("ts").cast("timestamp")
    text = F.when(F.col("event_id") % 7 == 0, "not a date").otherwise(
        F.concat(F.date_format(ts, "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format(ts, "yyyy"))
    )
    return views.table(spark, sf, "events").select(
        "event_id", F.date_format(parse_created_at(text), "yyyy-MM-dd HH:mm:ss").alias("parsed")
    )


# --- text --------------------------------------------------------------------


@query("first_valid_id", sql(f"SELECT tweet_id, ingest_seq, {sv.first_valid_id('in_response_to_tweet_id')} AS first_id FROM tweets_v"))
def first_valid_id_query(spark, sf):
    return views.tweets(spark, sf).select(
        "tweet_id", "ingest_seq", first_valid_id(F.col("in_response_to_tweet_id")).alias("first_id")
    )


def _text_query(name, table, key, col, expr, sql_expr):
    @query(name, f"SELECT {key}, md5({sql_expr}) AS digest, CAST(length({sql_expr}) AS BIGINT) AS n FROM {table}")
    def run(spark, sf):
        out = expr(F.col(col))
        return views.table(spark, sf, table).select(key, F.md5(out).alias("digest"), F.length(out).cast("bigint").alias("n"))

    return run


_text_query("strip_urls", "pages", "page_id", "html", tx.strip_urls, sv.replace("html", tx.URL_PATTERN))
_text_query("strip_mentions", "documents", "doc_id", "text", tx.strip_mentions, sv.replace("text", tx.MENTION_PATTERN))
_text_query("mask_pii", "documents", "doc_id", "text", tx.mask_pii, sv.mask_pii("text"))
_text_query("clean_text", "documents", "doc_id", "text", tx.clean_text, sv.clean("text"))
_text_query("clean_text_pages", "pages", "page_id", "html", tx.clean_text, sv.clean("html"))
_text_query(
    "clean_text_keep_mentions", "documents", "doc_id", "text",
    lambda c: tx.clean_text(c, keep_mentions=True), sv.clean("text", keep_mentions=True),
)
_text_query(
    "clean_text_mask_first", "documents", "doc_id", "text",
    lambda c: tx.clean_text(c, mask_first=True), sv.clean("text", mask_first=True),
)


@query(
    "pii_profile_by_lang",
    f"""SELECT lang, count(*) AS n, count(*) FILTER ({sv.mask_emails('text')} <> text) AS n_email,
  count(*) FILTER ({sv.mask_phones('text')} <> text) AS n_phone FROM documents GROUP BY lang""",
)
def pii_profile_by_lang(spark, sf):
    return profile.mask_profile(views.table(spark, sf, "documents"), "text", "lang")


@query(
    "tokenize_terms",
    f"SELECT term, count(*) AS n FROM (SELECT unnest({sv.retrieval_tokens('text')}) AS term FROM conversations) GROUP BY term",
)
def tokenize_terms(spark, sf):
    terms = views.table(spark, sf, "conversations").select(F.explode(tx.retrieval_tokens(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ngram_counts",
    f"""SELECT gram, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df FROM (
  SELECT id, gram, count(*) AS tf FROM (SELECT id, unnest({sv.grams('t')}) AS gram
    FROM (SELECT conv_id * 1000 + turn AS id, {sv.vector_tokens('text')} AS t FROM conversations)) GROUP BY id, gram)
GROUP BY gram""",
)
def ngram_counts(spark, sf):
    docs = views.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return gram_counts(docs).groupBy("gram").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))


@query(
    "length_histogram",
    f"""WITH t AS (SELECT {sv.token_count('text')} AS n FROM conversations WHERE text IS NOT NULL),
 e AS (SELECT min(n) AS lo, max(n) AS hi FROM t)
SELECT CAST(least(coalesce(floor((n - lo) * 50 / CAST(nullif(hi - lo, 0) AS DOUBLE)), 0), 49) AS BIGINT) AS bin, count(*) AS n
FROM t, e GROUP BY 1""",
)
def length_histogram(spark, sf):
    return profile.length_histogram(views.table(spark, sf, "conversations"), F.col("text"), 50)


@query("length_bucket_counts", sql(f"SELECT {sv.bucket('cleaned_text')} AS length_bucket, count(*) AS n FROM pairs_v GROUP BY 1"))
def length_bucket_counts(spark, sf):
    bucket = tx.length_bucket(F.col("cleaned_text"))
    return views.pairs(spark, sf).groupBy(bucket.alias("length_bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("inbound_counts", sql("SELECT CASE WHEN inbound THEN 'inbound' ELSE 'outbound' END AS direction, count(*) AS n FROM tweets_v GROUP BY 1"))
def inbound_counts(spark, sf):
    direction = F.when(F.col("inbound"), "inbound").otherwise("outbound")
    return views.tweets(spark, sf).groupBy(direction.alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "unsupported_numeric_claims",
    sql(
        r"""SELECT conversation_id, len(list_filter(regexp_extract_all(lower(reply), '\$\d+(?:\.\d+)?|\b\d+\s*(?:day|days|hour|hours)\b'),
  lambda c: NOT list_contains(regexp_extract_all(lower(reference), '\$\d+(?:\.\d+)?|\b\d+\s*(?:day|days|hour|hours)\b'), c))) > 0 AS unsupported
FROM (SELECT conversation_id, support_text || ' refund of $' || CAST(pair_seq % 40 AS VARCHAR) || '.50 in ' || CAST(pair_seq % 5 AS VARCHAR) || ' Days' AS reply,
  support_text || ' paid $' || CAST(pair_seq % 40 + pair_seq % 2 AS VARCHAR) || '.50 after ' || CAST(pair_seq % 5 AS VARCHAR) || ' days' AS reference FROM (SELECT conversation_id, support_text, """
        + views.MIXED_SQL
        + " AS pair_seq FROM pairs_v))"
    ),
)
def unsupported_numeric_claims(spark, sf):
    seq, base = views.mixed(F.col("pair_seq")), F.col("support_text")
    reply = F.concat(base, F.lit(" refund of $"), (seq % 40).cast("string"), F.lit(".50 in "), (seq % 5).cast("string"), F.lit(" Days"))
    reference = F.concat(base, F.lit(" paid $"), (seq % 40 + seq % 2).cast("string"), F.lit(".50 after "), (seq % 5).cast("string"), F.lit(" days"))
    return views.pairs(spark, sf).select("conversation_id", tx.has_unsupported_number(reply, reference).alias("unsupported"))


# --- profile -----------------------------------------------------------------


@query(
    "dataset_summary",
    sql(
        """SELECT count(*) AS n_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT tweet_id, author_id, inbound, created_at, text, response_tweet_id, in_response_to_tweet_id FROM tweets_v)) AS duplicate_row_count,
  count(*) - count(DISTINCT tweet_id) AS duplicate_tweet_id_count,
  count(*) FILTER (inbound) AS inbound_count, count(*) FILTER (NOT inbound) AS outbound_count,
  min(ts_sec) AS min_sec, max(ts_sec) AS max_sec, count(DISTINCT author_id) AS unique_authors FROM tweets_v"""
    ),
)
def dataset_summary(spark, sf):
    one = profile.dataset_summary(views.tweets(spark, sf))
    return one.select(
        "n_rows", "duplicate_row_count", "duplicate_tweet_id_count", "inbound_count", "outbound_count",
        _secs("min_created_at").alias("min_sec"), _secs("max_created_at").alias("max_sec"), "unique_authors",
    )


_NULL_COLUMNS = ["tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id"]


@query(
    "null_counts",
    sql(
        " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM tweets_v" for c in _NULL_COLUMNS)
        + " UNION ALL SELECT 'created_at_parsed', count(*) - count(ts_sec) FROM tweets_v"
    ),
)
def null_counts(spark, sf):
    return profile.null_counts(views.plain_tweets(spark, sf))


@query(
    "duplicate_counts",
    """SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)) AS n_dup_rows,
  count(*) - count(DISTINCT text) AS n_dup_text FROM documents""",
)
def duplicate_counts(spark, sf):
    return profile.duplicate_counts(views.table(spark, sf, "documents"), "text")


_DAY_COLUMNS = ["tweet_id", "author_id", "inbound", "created_at", "text"]
_DAY_SQL = (
    "count(*) AS n_rows, count(*) FILTER (inbound) AS inbound_count, count(*) FILTER (NOT inbound) AS outbound_count, "
    + "min(ts_sec) AS min_sec, max(ts_sec) AS max_sec, count(*) - count(ts_sec) AS null_created_at_parsed, "
    + ", ".join(f"count(*) - count({c}) AS null_{c}" for c in _DAY_COLUMNS)
)


def _stored_states(spark, sf):
    """States of four batches of the messages, written and read back."""
    rows = views.tweets(spark, sf)
    states = day_profile.day_states(rows, F.pmod(F.xxhash64("tweet_id"), F.lit(4)))
    return day_profile.read_states(spark, day_profile.write_states(states, scratch_path(spark, "day-states")))


def _day_counts(merged):
    nulls = [f"null_{c}" for c in [*_DAY_COLUMNS, "created_at_parsed"]]
    seconds = [_secs("min_created_at").alias("min_sec"), _secs("max_created_at").alias("max_sec")]
    return ["n_rows", "inbound_count", "outbound_count", *seconds, *nulls]


@query("profile_by_day", sql(f"SELECT CAST(floor(ts_sec / 86400.0) AS BIGINT) AS day, {_DAY_SQL} FROM tweets_v GROUP BY 1"))
def profile_by_day(spark, sf):
    """Exact part of the merged states, per day."""
    merged = day_profile.merge_states(_stored_states(spark, sf), "day")
    return merged.select(F.unix_date("day").cast("bigint").alias("day"), *_day_counts(merged))


@query(
    "profile_merged",
    sql(
        f"""SELECT {_DAY_SQL}, count(DISTINCT tweet_id) AS n_ids, count(DISTINCT author_id) AS n_authors, count(text) AS n_texts,
  true AS ids_near, true AS authors_near, true AS p50_near, true AS p90_near, true AS p99_near FROM tweets_v"""
    ),
)
def profile_merged(spark, sf):
    """All states as one: counts, and whether each estimate is within its stated error of a rescan."""
    merged = day_profile.merge_states(_stored_states(spark, sf))
    found = materialize(day_profile.report(merged))
    rows = views.tweets(spark, sf).select("tweet_id", "author_id", F.length("text").alias("length"))
    value = {q: found.select(f"length_{q}").scalar() for q in day_profile.QUANTILES}
    lengths = rows.agg(
        *[F.count_if(F.col("length") < v).alias(f"below_{q}") for q, v in value.items()],
        *[F.count_if(F.col("length") <= v).alias(f"upto_{q}") for q, v in value.items()],
    )
    ids = rows.groupBy("tweet_id").agg(F.lit(1)).agg(F.count("tweet_id").alias("n_ids"))
    authors = rows.groupBy("author_id").agg(F.lit(1)).agg(F.count("author_id").alias("n_authors"))
    both = found
    for exact in (lengths, ids, authors):
        both = both.withColumns({c: exact.select(c).scalar() for c in exact.columns})

    def near(estimate, exact):
        return F.abs(F.col(estimate) - F.col(exact)) <= F.col(exact) * day_profile.DISTINCT_ERROR

    def near_rank(name, q):
        n, e = F.col("n_texts"), day_profile.RANK_ERROR
        return ((F.col(f"below_{name}") <= n * (q + e)) & (F.col(f"upto_{name}") >= n * (q - e))).alias(f"{name}_near")

    return both.select(
        *_day_counts(both), "n_ids", "n_authors", "n_texts",
        near("distinct_ids", "n_ids").alias("ids_near"), near("distinct_authors", "n_authors").alias("authors_near"),
        *[near_rank(name, q) for name, q in day_profile.QUANTILES.items()],
    )


# --- accounts ----------------------------------------------------------------

sv.define(
    "author_stats_v",
    """SELECT author_id, count(*) FILTER (NOT inbound) AS n_outbound, count(tweet_id) AS n_total,
  count(*) FILTER (NOT inbound) / CAST(count(tweet_id) AS DOUBLE) AS outbound_share
FROM tweets_v WHERE author_id IS NOT NULL GROUP BY author_id HAVING count(*) FILTER (NOT inbound) > 0""",
)
sv.define(
    "last_v",
    "SELECT tweet_id, arg_max(author_id, ingest_seq) AS customer FROM tweets_v WHERE inbound GROUP BY tweet_id",
)
for _name, _id in [("thread_stats_v", "in_response_to_tweet_id"), ("thread_stats_parsed_v", sv.first_valid_id("in_response_to_tweet_id"))]:
    sv.define(
        _name,
        f"""SELECT t.author_id, count(*) AS n_complete_threads, count(DISTINCT l.customer) AS n_distinct_customers
FROM (SELECT author_id, {_id} AS target FROM tweets_v WHERE NOT inbound) t JOIN last_v l ON l.tweet_id = t.target GROUP BY t.author_id""",
    )
sv.define(
    "candidates_v",
    """SELECT a.*, coalesce(n_complete_threads, 0) AS n_complete_threads, coalesce(n_distinct_customers, 0) AS n_distinct_customers,
  coalesce(n_complete_threads, 0) * 1.0::DOUBLE + coalesce(n_distinct_customers, 0) * 1.5::DOUBLE AS score
FROM author_stats_v a LEFT JOIN thread_stats_v t USING (author_id)
WHERE outbound_share >= 0.95 AND coalesce(n_distinct_customers, 0) >= 20""",
)


@query("author_stats", sql("SELECT author_id, n_outbound, n_total, round(outbound_share, 6) AS outbound_share FROM author_stats_v"))
def author_stats(spark, sf):
    return brands.author_stats(views.tweets(spark, sf)).withColumn("outbound_share", F.round("outbound_share", 6))


@query("thread_stats", sql("SELECT * FROM thread_stats_v"))
def thread_stats(spark, sf):
    return brands.thread_stats(views.tweets(spark, sf))


@query("thread_stats_parsed_ids", sql("SELECT * FROM thread_stats_parsed_v"))
def thread_stats_parsed_ids(spark, sf):
    return brands.thread_stats(views.tweets(spark, sf), parse_ids=True)


@query("rank_brand_candidates", sql("SELECT * REPLACE (round(outbound_share, 6) AS outbound_share) FROM candidates_v"))
def rank_brand_candidates(spark, sf):
    out = brands.rank_brand_candidates(views.tweets(spark, sf), min_distinct_customers=20)
    return out.withColumn("outbound_share", F.round("outbound_share", 6))


_BRAND_COLUMNS = "author_id AS brand_id, n_complete_threads AS n_conversations, n_distinct_customers AS n_inbound, n_outbound"


@query("select_brand", sql(f"SELECT {_BRAND_COLUMNS} FROM candidates_v ORDER BY score DESC, author_id LIMIT 1"))
def select_brand(spark, sf):
    candidates = brands.rank_brand_candidates(views.tweets(spark, sf), min_distinct_customers=20)
    return brands.select_brand(candidates).drop("selection_reason")


@query("select_brand_forced", sql(f"SELECT {_BRAND_COLUMNS} FROM candidates_v WHERE author_id = 'brand_1'"))
def select_brand_forced(spark, sf):
    candidates = brands.rank_brand_candidates(views.tweets(spark, sf), min_distinct_customers=20)
    return brands.select_brand(candidates, "brand_1").drop("selection_reason")


# --- pairs -------------------------------------------------------------------

_PAIR_SQL = """SELECT conversation_id, customer_tweet_id, md5(customer_text) AS customer_md5, support_tweet_id,
  md5(support_text) AS support_md5, ts_sec, customer_author, support_author, md5(cleaned_text) AS cleaned_md5 FROM pairs_v"""


def _pair_output(pairs):
    return pairs.select(
        "conversation_id", "customer_tweet_id", F.md5("customer_text").alias("customer_md5"), "support_tweet_id",
        F.md5("support_text").alias("support_md5"), _secs("timestamp").alias("ts_sec"), "customer_author",
        "support_author", F.md5("cleaned_text").alias("cleaned_md5"),
    )


@query("reconstruct_pairs", sql(_PAIR_SQL))
def reconstruct_pairs(spark, sf):
    return _pair_output(threads.with_text_fields(threads.reconstruct_pairs(views.tweets(spark, sf))))


@query("reconstruct_pairs_one_brand", sql(_PAIR_SQL + " WHERE support_author = 'brand_2'"))
def reconstruct_pairs_one_brand(spark, sf):
    return _pair_output(threads.with_text_fields(threads.reconstruct_pairs(views.tweets(spark, sf), "brand_2")))


@query(
    "pair_outcome_counts",
    sql(
        """SELECT CASE WHEN target_id IS NULL THEN 'malformed_id' WHEN f.tweet_id IS NULL THEN 'missing_customer'
  WHEN NOT f.inbound THEN 'not_a_customer' ELSE 'pair' END AS outcome, support_author, count(*) AS n
FROM support_v s LEFT JOIN first_v f ON f.tweet_id = s.target_id GROUP BY 1, 2"""
    ),
)
def pair_outcome_counts(spark, sf):
    return threads.pair_outcome_counts(views.tweets(spark, sf))


# --- splits and samples ------------------------------------------------------


@query("time_quartile", sql("SELECT length_bucket, time_quartile, count(*) AS n FROM strata_v GROUP BY 1, 2"))
def time_quartile(spark, sf):
    strata = sampling.with_strata(views.pairs(spark, sf)).where(F.col("time_quartile").isNotNull())
    return strata.groupBy("length_bucket", "time_quartile").agg(F.count(F.lit(1)).alias("n"))


@query("chronological_split", sql("SELECT conversation_id, time_rank, split FROM splits_v"))
def chronological_split(spark, sf):
    return views.flow(spark, sf)[1].select("conversation_id", "time_rank", "split")


@query("split_sizes", sql("SELECT split, count(*) AS n, count(DISTINCT intent) AS n_intents FROM splits_v GROUP BY split"))
def split_sizes(spark, sf):
    splits = views.flow(spark, sf)[1]
    return splits.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("intent").alias("n_intents"))


@query(
    "dedup_keep_first",
    "SELECT md5(text) AS digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text",
)
def dedup_keep_first(spark, sf):
    docs = views.table(spark, sf, "documents")
    return sampling.dedup_keep_first(docs, "text", "doc_id").select(F.md5("text").alias("digest"), "doc_id", "source")


@query(
    "golden_stratified_sample",
    sql(
        f"""SELECT s.conversation_id, s.rk AS position, {sv.bucket('d.cleaned_text')} AS length_bucket, st.time_quartile
FROM full_sample_v s JOIN dedup_v d USING (conversation_id) LEFT JOIN strata_v st USING (conversation_id)"""
    ),
)
def golden_stratified_sample(spark, sf):
    sample = sampling.stratified_sample(views.pairs(spark, sf), 200)
    # At most 200 rows.
    order = Window.orderBy(ranking.hash_order("conversation_id", 43), F.col("conversation_id"))
    return sample.select(
        "conversation_id", F.row_number().over(order).cast("bigint").alias("position"), "length_bucket", "time_quartile"
    )


@query("human_rating_sample", "SELECT CAST(doc_id AS VARCHAR) AS example_id FROM labels ORDER BY md5(CAST(doc_id AS VARCHAR) || '#42'), example_id LIMIT 50")
def human_rating_sample(spark, sf):
    return ranking.hash_sample(views.ratings(spark, sf, "human"), "example_id", 50, 42).select("example_id")


# --- golden set and leakage ----------------------------------------------------


@query(
    "golden_complete_rows",
    sql("SELECT example_id, md5(customer_text) AS digest, gold_intent, gold_escalate FROM golden_complete_v"),
)
def golden_complete_rows(spark, sf):
    rows = tables.complete_golden_rows(views.golden(spark, sf))
    return rows.select("example_id", F.md5("customer_text").alias("digest"), "gold_intent", "gold_escalate")


def _in(values):
    return "(" + ", ".join(sv.lit(v) for v in values) + ")"


_CHECKS = {
    "duplicate_example_id": ("count(*) - count(DISTINCT example_id)", "error"),
    "duplicate_customer_text": ("count(*) - count(DISTINCT customer_text)", "error"),
    "size_out_of_range": ("CASE WHEN count(*) BETWEEN 150 AND 250 THEN 0 ELSE count(*) END", "error"),
    "missing_gold_intent": ("count(*) FILTER (gold_intent IS NULL OR trim(gold_intent) = '')", "error"),
    "missing_gold_escalate": ("count(*) FILTER (gold_escalate IS NULL OR trim(gold_escalate) = '')", "error"),
    "unknown_intent_value": (f"count(DISTINCT gold_intent) FILTER (gold_intent NOT IN {_in(INTENTS)})", "error"),
    "unknown_decision_value": ("count(DISTINCT gold_escalate) FILTER (gold_escalate NOT IN ('AUTO_HANDLE', 'ESCALATE'))", "error"),
    "escalation_without_reason": ("count(*) FILTER (gold_escalate = 'ESCALATE' AND coalesce(trim(gold_escalation_reason), '') = '')", "error"),
    "unknown_reason_code": (
        f"count(DISTINCT gold_escalation_reason) FILTER (gold_escalate = 'ESCALATE' AND trim(gold_escalation_reason) <> '' AND gold_escalation_reason NOT IN {_in(REASON_CODES)})",
        "error",
    ),
    "rare_intent": (
        "max((SELECT count(*) FROM (SELECT gold_intent FROM golden_v WHERE gold_intent IS NOT NULL GROUP BY gold_intent HAVING count(*) < 3)))",
        "warning",
    ),
}


@query(
    "golden_set_checks",
    sql(
        " UNION ALL ".join(
            f"SELECT '{name}' AS \"check\", CAST({expr} AS BIGINT) AS n_bad, {expr} = 0 AS passed, '{sev}' AS severity FROM golden_v"
            for name, (expr, sev) in _CHECKS.items()
        )
    ),
)
def golden_set_checks(spark, sf):
    return golden.golden_set_checks(views.golden(spark, sf), intent_dimension(spark))


@query("golden_completion", sql("SELECT count(*) AS n_rows, round(100.0 * count(gold_intent) / CAST(count(*) AS DOUBLE), 6) AS completion_pct FROM golden_v"))
def golden_completion(spark, sf):
    one = golden.golden_completion(views.golden(spark, sf))
    return one.withColumn("completion_pct", F.round("completion_pct", 6))


@query("human_scores_usable", sql("SELECT example_id, groundedness, overall FROM human_v"))
def human_scores_usable(spark, sf):
    return tables.usable_human_scores(views.ratings(spark, sf, "human")).select("example_id", "groundedness", "overall")


@query("human_scores_incomplete", sql("SELECT example_id, groundedness FROM judge_v WHERE NOT EXISTS (SELECT 1 FROM judge_v WHERE groundedness IS NULL)"))
def human_scores_incomplete(spark, sf):
    """One missing rating rejects the whole table."""
    return tables.usable_human_scores(views.ratings(spark, sf, "judge")).select("example_id", "groundedness")


@query(
    "golden_excluded_rows",
    sql("SELECT conversation_id FROM pairs_v WHERE cleaned_text NOT IN (SELECT customer_text FROM golden_v)"),
)
def golden_excluded_rows(spark, sf):
    texts = views.golden(spark, sf).select("customer_text")
    return sampling.exclude_texts(views.pairs(spark, sf), texts).select("conversation_id")


@query(
    "golden_excluded_rows_raw",
    sql("SELECT conversation_id FROM pairs_v WHERE customer_text NOT IN (SELECT customer_text FROM golden_v)"),
)
def golden_excluded_rows_raw(spark, sf):
    """Exclusion by raw text: misses golden texts that cleaning changed."""
    texts = views.golden(spark, sf).select("customer_text")
    return sampling.exclude_texts(views.pairs(spark, sf), texts, "customer_text").select("conversation_id")


# Messages repeated into every third split row, so that the checks find something.
sv.define(
    "leaky_splits_v",
    """SELECT cleaned_text, split FROM splits_v
UNION ALL SELECT cleaned_text, 'val' FROM splits_v WHERE pair_seq % 3 = 0
UNION ALL SELECT customer_text, 'train' FROM golden_v WHERE qid % 2 = 0""",
)


def _leaky(golden_rows, splits):
    base = splits.select("cleaned_text", "split", "pair_seq")
    repeated = base.where(F.col("pair_seq") % 3 == 0).withColumn("split", F.lit("val"))
    planted = golden_rows.where(F.col("qid") % 2 == 0).select(
        F.col("customer_text").alias("cleaned_text"), F.lit("train").alias("split")
    )
    return base.unionByName(repeated).drop("pair_seq").unionByName(planted)


@query(
    "cross_split_duplicates",
    sql(
        """SELECT md5(cleaned_text) AS digest, count(DISTINCT split) AS n_splits FROM leaky_splits_v
GROUP BY cleaned_text HAVING count(DISTINCT split) > 1"""
    ),
)
def cross_split_duplicates(spark, sf):
    rows = leakage.cross_split_duplicates(_leaky(*views.flow(spark, sf)))
    return rows.select(F.md5("cleaned_text").alias("digest"), "n_splits")


def _report_sql(splits, corpus):
    return f"""SELECT "check", n_overlap = 0 AS passed, n_overlap, CASE WHEN max(n_overlap) OVER () > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM (
  SELECT 'golden_not_in_train' AS "check", (SELECT count(DISTINCT customer_text) FROM golden_v WHERE customer_text IN (SELECT cleaned_text FROM {splits} WHERE split = 'train')) AS n_overlap
  UNION ALL SELECT 'no_cross_split_duplicates', (SELECT count(*) FROM (SELECT cleaned_text FROM {splits} GROUP BY cleaned_text HAVING count(DISTINCT split) > 1))
  UNION ALL SELECT 'golden_not_in_retrieval_index', (SELECT count(DISTINCT customer_text) FROM golden_v WHERE customer_text IN (SELECT {corpus[1]} FROM {corpus[0]}))
  UNION ALL SELECT 'golden_labels_not_derived_from_predictions', 0)"""


@query("leakage_report", sql(_report_sql("splits_v", ("corpus_v", "customer_text"))))
def leakage_report(spark, sf):
    golden_rows, splits = views.flow(spark, sf)
    corpus = splits.where(F.col("split") == "train").select(F.col("cleaned_text").alias("customer_text"))
    return leakage.leakage_report(golden_rows, splits, corpus)


@query("leakage_report_planted", sql(_report_sql("leaky_splits_v", ("(SELECT cleaned_text FROM leaky_splits_v WHERE split = 'train')", "cleaned_text"))))
def leakage_report_planted(spark, sf):
    golden_rows, splits = views.flow(spark, sf)
    leaky = _leaky(golden_rows, splits)
    corpus = leaky.where(F.col("split") == "train").select(F.col("cleaned_text").alias("customer_text"))
    return leakage.leakage_report(golden_rows, leaky, corpus)


def _spaced(expr):
    return f"' ' || array_to_string({sv.space_tokens(f'lower({expr})')}, ' ') || ' '"


@query(
    "benchmark_containment",
    sql(
        f"""SELECT b.item_id, d.doc_id FROM (SELECT DISTINCT item_id, {_spaced('text')} AS words FROM benchmark WHERE item_id IS NOT NULL) b
JOIN (SELECT DISTINCT doc_id, {_spaced('text')} AS words FROM documents WHERE doc_id IS NOT NULL) d ON contains(d.words, b.words)
WHERE trim(b.words) <> '' GROUP BY b.item_id, d.doc_id"""
    ),
)
def benchmark_containment(spark, sf):
    """Documents that contain a whole benchmark text."""
    return leakage.contained_items(views.table(spark, sf, "benchmark"), views.table(spark, sf, "documents"))
