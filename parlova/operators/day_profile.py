"""A profile kept per batch and day: new rows add a state, old rows are not read again.

A state holds exact counts and, where exact values cannot be merged in bounded space,
sketches: distinct ids and authors (HLL), text lengths (KLL). States of disjoint rows
merge by sums, extremes and sketch unions, so a report over any days reads small rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HLL_LG_K = 12
KLL_K = 200
# Three standard errors of a union of 2^12 registers; rank error of KLL at k = 200.
DISTINCT_ERROR = 3 * 1.04 / (1 << HLL_LG_K) ** 0.5
RANK_ERROR = 0.0165
QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}

_SUMS = ["n_rows", "inbound_count", "outbound_count"]


def _null_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("null_")]


def day_states(
    tweets: DataFrame,
    batch: Column,
    time_col: str = "created_at_parsed",
    counted: tuple[str, ...] = ("tweet_id", "author_id", "inbound", "created_at", "text", "created_at_parsed"),
) -> DataFrame:
    """One state per ``batch`` and UTC day, in one scan with partial aggregates.

    Rows without a readable time have a null day. ``counted`` names the columns whose nulls
    are counted (as ``null_<name>``). Null ids, authors and texts are in no sketch; a sketch
    without values is an empty one. An empty table gives no states.
    """
    when = F.col(time_col)
    return (
        tweets.withColumns({"batch": batch, "day": F.to_date(when)})
        .groupBy("batch", "day")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if("inbound").alias("inbound_count"),
            F.count_if(~F.col("inbound")).alias("outbound_count"),
            F.min(when).alias("min_created_at"),
            F.max(when).alias("max_created_at"),
            *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in counted],
            F.hll_sketch_agg("tweet_id", HLL_LG_K).alias("ids"),
            F.hll_sketch_agg("author_id", HLL_LG_K).alias("authors"),
            F.kll_sketch_agg_bigint(F.length("text").cast("bigint"), KLL_K).alias("lengths"),
        )
    )


def write_states(states: DataFrame, path: str) -> str:
    """Add the states of whole batches; a batch that is written again replaces its states."""
    states.write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return path


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_states(states: DataFrame, *by: str) -> DataFrame:
    """States merged per ``by`` (``day``, ``batch``), or all into one row."""
    return states.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in [*_SUMS, *_null_columns(states)]],
        F.min("min_created_at").alias("min_created_at"),
        F.max("max_created_at").alias("max_created_at"),
        F.hll_union_agg("ids").alias("ids"),
        F.hll_union_agg("authors").alias("authors"),
        F.kll_merge_agg_bigint("lengths").alias("lengths"),
    )


def report(merged: DataFrame) -> DataFrame:
    """Counts as they are; distinct ids and authors and length quantiles as estimates.

    Quantiles are null where no row has a text.
    """
    sketches = {"ids", "authors", "lengths"}
    n_texts = F.kll_sketch_get_n_bigint("lengths")
    quantiles = [
        F.when(n_texts > 0, F.kll_sketch_get_quantile_bigint("lengths", F.lit(q))).alias(f"length_{name}")
        for name, q in QUANTILES.items()
    ]
    return merged.select(
        *[c for c in merged.columns if c not in sketches],
        F.hll_sketch_estimate("ids").alias("distinct_ids"),
        F.hll_sketch_estimate("authors").alias("distinct_authors"),
        n_texts.alias("n_texts"),
        *quantiles,
    )
