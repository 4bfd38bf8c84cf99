"""Dataset profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlova.functions.ids import row_digest
from parlova.functions.text import mask_emails, mask_phones, token_count
from parlova.runtime import materialize


def duplicate_counts(df: DataFrame, text_col: str | None = None) -> DataFrame:
    """Rows beyond the first of each identical row (and of each identical text).

    Rows are compared by SHA-256, so 32 bytes per distinct row are shuffled
    instead of whole texts.
    """
    groups = df.groupBy(row_digest(*df.columns).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    stats = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_dup_rows"),
    )
    if text_col is None:
        return stats
    n_text = df.groupBy(row_digest(text_col).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    dup_text = n_text.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n"))
    return stats.withColumn("n_dup_text", dup_text.select("n").scalar())


def dataset_summary(tweets: DataFrame) -> DataFrame:
    """One row: counts, duplicates, time range, distinct authors."""
    base = tweets.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("inbound").alias("inbound_count"),
        F.count_if(~F.col("inbound")).alias("outbound_count"),
        F.min("created_at_parsed").alias("min_created_at"),
        F.max("created_at_parsed").alias("max_created_at"),
    )
    n_rows = F.col("n_rows")
    ids = tweets.groupBy("tweet_id").agg(F.lit(1).alias("_")).agg(F.count(F.lit(1)).alias("n"))
    authors = (
        tweets.where(F.col("author_id").isNotNull())
        .groupBy("author_id")
        .agg(F.lit(1).alias("_"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    dup_rows = duplicate_counts(tweets.drop("ingest_seq")).select("n_dup_rows").scalar()
    return base.select(
        "n_rows",
        dup_rows.alias("duplicate_row_count"),
        (n_rows - ids.select("n").scalar()).alias("duplicate_tweet_id_count"),
        "inbound_count",
        "outbound_count",
        "min_created_at",
        "max_created_at",
        authors.select("n").scalar().alias("unique_authors"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: its null count, from a single scan."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column_name", "n_null")


def mask_profile(df: DataFrame, text_col: str, by: str) -> DataFrame:
    """Rows changed by each mask, per group."""
    text = F.col(text_col)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(mask_emails(text) != text).alias("n_email"),
        F.count_if(mask_phones(text) != text).alias("n_phone"),
    )


def length_histogram(df: DataFrame, text: Column, bins: int = 50) -> DataFrame:
    """Equal-width bins of the token count between its minimum and maximum."""
    lengths = df.where(text.isNotNull()).select(token_count(text).cast("bigint").alias("n_tokens"))
    # A row per length: the texts are read once, and the edges follow from the lengths.
    counts = materialize(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("_n")))
    edges = counts.agg(F.min("n_tokens").alias("lo"), F.max("n_tokens").alias("hi"))
    lo, hi = edges.select("lo").scalar(), edges.select("hi").scalar()
    step = F.floor((F.col("n_tokens") - lo) * bins / F.nullif(hi - lo, F.lit(0)))
    bin_no = F.least(F.coalesce(step, F.lit(0)), F.lit(bins - 1)).cast("bigint")
    return counts.groupBy(bin_no.alias("bin")).agg(F.sum("_n").alias("n"))
