"""Splits, de-duplication and stratified sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlova.functions.ids import row_digest
from parlova.functions.text import length_bucket
from parlova.operators.ranking import global_rank, hash_order, quartile_of_rank, top_k
from parlova.runtime import materialize


def dedup_keep_first(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """The first row of each ``key`` by ``order_col`` (unique per row).

    Keys are compared by SHA-256: only 32-byte digests and ``order_col`` are aggregated,
    and the kept rows are fetched by a join on ``order_col``.
    """
    marked = df.withColumn("_key", row_digest(key))
    first = marked.groupBy(F.col("_key").alias("_k")).agg(F.min(order_col).alias("_first"))
    return marked.join(first, (F.col("_key") == F.col("_k")) & (F.col(order_col) == F.col("_first")), "left_semi").drop("_key")


def exclude_texts(df: DataFrame, texts: DataFrame, text_col: str = "cleaned_text") -> DataFrame:
    """Drop rows whose text occurs in ``texts`` (one column), compared by SHA-256."""
    banned = texts.select(F.col(texts.columns[0]).alias("_t")).where("_t IS NOT NULL").select(row_digest("_t").alias("_banned")).distinct()
    marked = df.withColumn("_digest", row_digest(text_col))
    return marked.join(banned, F.col("_digest") == F.col("_banned"), "left_anti").select(*df.columns)


def chronological_split(
    pairs: DataFrame,
    train_frac: float = 0.70,
    val_frac: float = 0.15,
    golden_texts: DataFrame | None = None,
    golden_col: str = "cleaned_text",
    time_col: str = "timestamp",
    tie_cols: tuple[str, ...] = ("pair_seq", "conversation_id"),
) -> DataFrame:
    """Oldest rows to train, then val, the remainder to test, as a ``split`` column.

    Rows without time are dropped, and so are rows whose ``golden_col`` equals a
    golden text (cleaned text by default, since golden texts are stored cleaned).
    """
    timed = pairs.where(F.col(time_col).isNotNull())
    if golden_texts is not None:
        timed = exclude_texts(timed, golden_texts, golden_col)
    ranked = global_rank(timed, [time_col, *tie_cols], "time_rank")
    n_train, n_val = int(ranked.n * train_frac), int(ranked.n * val_frac)
    return ranked.rows.withColumn(
        "split",
        F.when(F.col("time_rank") <= n_train, "train")
        .when(F.col("time_rank") <= n_train + n_val, "val")
        .otherwise("test"),
    )


def with_strata(pairs: DataFrame, time_col: str = "timestamp") -> DataFrame:
    """(pair_seq, conversation_id, length_bucket, time_quartile) of the first pair per cleaned text.

    The quartile is null without time. Texts stay behind: only ids are ranked.
    """
    slim = pairs.select(
        "conversation_id",
        "pair_seq",
        time_col,
        length_bucket(F.col("cleaned_text")).alias("length_bucket"),
        row_digest("cleaned_text").alias("_text"),
    )
    first = top_k(slim, ["_text"], [F.col("pair_seq")], 1, "_rn").drop("_text", "_rn")
    ranked = global_rank(first, [F.col(time_col).asc_nulls_last(), F.col("pair_seq")], "time_rank")
    n = ranked.rows.agg(F.count(time_col)).first()[0]
    quartile = F.when(F.col(time_col).isNotNull(), quartile_of_rank(F.col("time_rank"), n))
    return ranked.rows.withColumn("time_quartile", quartile).drop(time_col)


def stratified_sample(pairs: DataFrame, target: int = 200, seed: int = 42) -> DataFrame:
    """Equal numbers per (length bucket, time quartile), topped up to ``target``.

    Rows without time enter only through the top-up. Order and choice follow a
    hash of the id, so the sample is the same on every run and cluster. Rows are told
    apart by ``pair_seq``, as a conversation id may repeat.
    """
    pool = with_strata(pairs)
    strata = pool.where(F.col("time_quartile").isNotNull())
    # At most 3 x 4 strata; their number and the sample size shape the plan.
    n_strata = strata.select("length_bucket", "time_quartile").distinct().count()
    per_stratum = max(1, target // max(1, n_strata))
    pick = [hash_order("conversation_id", seed), F.col("conversation_id"), F.col("pair_seq")]
    sampled = materialize(
        top_k(strata, ["length_bucket", "time_quartile"], pick, per_stratum, "_rn").select(*pool.columns)
    )
    n_sampled = sampled.count()
    if n_sampled < target:
        rest = pool.join(sampled.select("pair_seq"), "pair_seq", "left_anti")
        top_up = _hash_sample(rest.select(*pool.columns), target - n_sampled, seed)
        sampled = sampled.unionByName(top_up)
    chosen = _hash_sample(sampled, target, seed + 1).drop("time_rank", "conversation_id")
    # Only the chosen ids go back to the pairs for their texts.
    return pairs.join(chosen, "pair_seq")


def _hash_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows by a hash of the id; ranked over partitions, so ``n`` may be large."""
    ranked = global_rank(df, [hash_order("conversation_id", seed), F.col("conversation_id"), F.col("pair_seq")], "_place")
    return ranked.rows.where(F.col("_place") <= n).drop("_place")


def golden_candidates(sample: DataFrame, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """Annotation table with empty gold columns, numbered in hash order."""
    ties = [F.col("pair_seq")] if "pair_seq" in sample.columns else []
    ranked = global_rank(sample, [hash_order("conversation_id", seed + 1), F.col("conversation_id"), *ties], "_place").rows
    empty = {
        c: F.lit(None).cast("string")
        for c in [
            "candidate_intent",
            "gold_intent",
            "gold_reply_quality",
            "gold_escalate",
            "gold_escalation_reason",
            "annotator_notes",
        ]
    }
    return ranked.select(
        F.format_string("golden_%04d", F.col("_place") - 1).alias("example_id"),
        F.col("cleaned_text").alias("customer_text"),
        F.col("raw_text").alias("context"),
        *[c.alias(n) for n, c in empty.items()],
        *keep,
    )
