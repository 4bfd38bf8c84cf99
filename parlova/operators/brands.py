"""Support-account ranking and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlova.functions.ids import first_valid_id
from parlova.operators.skew import hot_keys, lookup_join

# Thresholds and score weights.
MIN_OUTBOUND_SHARE = 0.95
MIN_DISTINCT_CUSTOMERS = 50
THREAD_WEIGHT = 1.0
CUSTOMER_WEIGHT = 1.5


def author_stats(tweets: DataFrame) -> DataFrame:
    """Outbound count, total and share per author, in one aggregation."""
    return (
        tweets.where(F.col("author_id").isNotNull())
        .groupBy("author_id")
        .agg(
            F.count_if(~F.col("inbound") & F.col("tweet_id").isNotNull()).alias("n_outbound"),
            F.count("tweet_id").alias("n_total"),
            F.count_if(~F.col("inbound")).alias("_outbound_rows"),
        )
        .where(F.col("_outbound_rows") > 0)
        .drop("_outbound_rows")
        .withColumn("outbound_share", F.try_divide("n_outbound", "n_total"))
    )


def thread_stats(tweets: DataFrame, parse_ids: bool = False) -> DataFrame:
    """Answered customer messages and distinct customers per outbound author.

    By default the reply id is used as it stands, so a comma list matches
    nothing; ``parse_ids`` takes its first id instead. A repeated customer id
    counts with its last author.
    """
    reply_to = F.col("in_response_to_tweet_id")
    replies = (
        tweets.where(~F.col("inbound") & F.col("author_id").isNotNull() & reply_to.isNotNull())
        .select("author_id", "ingest_seq", (first_valid_id(reply_to) if parse_ids else reply_to).alias("target_id"))
        .where(F.col("target_id").isNotNull())
    )
    customers = (
        tweets.where(F.col("inbound"))
        .groupBy(F.col("tweet_id").alias("target_id"))
        .agg(F.max_by("author_id", "ingest_seq").alias("customer"))
        .where(F.col("customer").isNotNull())
    )
    matched = lookup_join(replies, customers, "target_id", "ingest_seq", hot_keys(replies, "target_id"))
    # Two steps, so the distinct count of a huge account is spread by customer.
    per_customer = matched.groupBy("author_id", "customer").agg(F.count(F.lit(1)).alias("_n"))
    return per_customer.groupBy("author_id").agg(
        F.sum("_n").alias("n_complete_threads"),
        F.count(F.lit(1)).alias("n_distinct_customers"),
    )


def rank_brand_candidates(
    tweets: DataFrame,
    min_outbound_share: float = MIN_OUTBOUND_SHARE,
    min_distinct_customers: int = MIN_DISTINCT_CUSTOMERS,
    parse_ids: bool = False,
) -> DataFrame:
    """Accounts that look like support accounts, with their score."""
    return (
        author_stats(tweets)
        .join(thread_stats(tweets, parse_ids), "author_id", "left")
        .na.fill(0, ["n_complete_threads", "n_distinct_customers"])
        .where(
            (F.col("outbound_share") >= min_outbound_share)
            & (F.col("n_distinct_customers") >= min_distinct_customers)
        )
        .withColumn(
            "score",
            F.col("n_complete_threads") * F.lit(THREAD_WEIGHT)
            + F.col("n_distinct_customers") * F.lit(CUSTOMER_WEIGHT),
        )
    )


def select_brand(candidates: DataFrame, forced: str | None = None) -> DataFrame:
    """One row: the chosen account (highest score, then smallest id)."""
    best_first = [F.col("score").desc(), F.col("author_id")]
    if forced is not None:
        chosen = candidates.where(F.col("author_id") == forced)
        if chosen.isEmpty():
            top = [r.author_id for r in candidates.orderBy(*best_first).limit(10).collect()]
            raise ValueError(f"account {forced!r} is not a candidate; best candidates: {top}")
    else:
        chosen = candidates.orderBy(*best_first).limit(1)
        if chosen.isEmpty():
            raise ValueError("no account meets the thresholds; lower them or supply more data")
    return chosen.select(
        F.col("author_id").alias("brand_id"),
        F.col("n_complete_threads").alias("n_conversations"),
        F.col("n_distinct_customers").alias("n_inbound"),
        "n_outbound",
        F.concat(
            F.lit("highest thread and customer score; outbound share "),
            F.format_number("outbound_share", 2),
        ).alias("selection_reason"),
    )
