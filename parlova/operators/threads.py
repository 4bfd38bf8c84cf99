"""Joining support replies to the customer messages they answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlova.functions.ids import first_valid_id
from parlova.functions.text import clean_text
from parlova.operators.skew import hot_keys, lookup_join


def _replies_with_target(tweets: DataFrame, brand: str | None) -> DataFrame:
    support = tweets.where(~F.col("inbound"))
    if brand is not None:
        support = support.where(F.col("author_id") == brand)
    return support.select(
        F.col("tweet_id").alias("support_tweet_id"),
        F.col("text").alias("support_text"),
        F.col("created_at_parsed").alias("timestamp"),
        F.col("author_id").alias("support_author"),
        F.col("ingest_seq").alias("pair_seq"),
        first_valid_id(F.col("in_response_to_tweet_id")).alias("target_id"),
    )


def _first_rows(tweets: DataFrame, replies: DataFrame, *fields: str) -> DataFrame:
    """One row per message id that a reply names: the first in read order decides.

    Only ids and row numbers are aggregated; the fields, texts among them, are fetched
    for the first rows alone. ``ingest_seq`` is unique per row.
    """
    wanted = replies.select("target_id").distinct()
    named = tweets.join(wanted, F.col("tweet_id") == F.col("target_id"), "left_semi")
    first = named.groupBy(F.col("tweet_id").alias("_id")).agg(F.min("ingest_seq").alias("_seq"))
    rows = tweets.join(first, (F.col("tweet_id") == F.col("_id")) & (F.col("ingest_seq") == F.col("_seq")))
    return rows.select(F.col("_id").alias("target_id"), F.struct(*fields).alias("target"))


def reconstruct_pairs(tweets: DataFrame, brand: str | None = None) -> DataFrame:
    """(customer message, support reply) pairs; all accounts when no brand is given."""
    replies = _replies_with_target(tweets, brand).where(F.col("target_id").isNotNull())
    hot = hot_keys(replies, "target_id")
    # Only customers' texts are needed; the others would move for nothing.
    told = tweets.withColumn("text", F.when(F.col("inbound"), F.col("text")))
    targets = _first_rows(told, replies, "inbound", "author_id", "text")
    joined = lookup_join(replies, targets, "target_id", "pair_seq", hot)
    return joined.where(F.col("target.inbound")).select(
        F.concat_ws("__", "target_id", "support_tweet_id").alias("conversation_id"),
        F.col("target_id").alias("customer_tweet_id"),
        F.col("target.text").alias("customer_text"),
        "support_tweet_id",
        "support_text",
        "timestamp",
        F.col("target.author_id").alias("customer_author"),
        "support_author",
        "pair_seq",
    )


def with_text_fields(pairs: DataFrame, text_col: str = "customer_text") -> DataFrame:
    return pairs.withColumns(
        {"raw_text": F.col(text_col), "cleaned_text": clean_text(F.col(text_col))}
    )


def pair_outcome_counts(tweets: DataFrame, brand: str | None = None) -> DataFrame:
    """How each support row fared: paired, malformed id, missing or non-customer target."""
    replies = _replies_with_target(tweets, brand).drop("support_text")
    with_id = replies.where(F.col("target_id").isNotNull())
    targets = _first_rows(tweets, with_id, "inbound")
    joined = lookup_join(with_id, targets, "target_id", "pair_seq", hot_keys(with_id, "target_id"), "left")
    outcome = (
        F.when(F.col("target").isNull(), "missing_customer")
        .when(~F.col("target.inbound"), "not_a_customer")
        .otherwise("pair")
    )
    classified = joined.select(outcome.alias("outcome"), "support_author").unionByName(
        replies.where(F.col("target_id").isNull()).select(
            F.lit("malformed_id").alias("outcome"), "support_author"
        )
    )
    return classified.groupBy("outcome", "support_author").agg(F.count(F.lit(1)).alias("n"))
