"""Judge summaries and the agreement of judge and human ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlova.functions.payload import parse_ratings
from parlova.schemas import RATING_DIMENSIONS


def judge_rows(responses: DataFrame) -> DataFrame:
    """(example_id, status, ratings…) from raw answers (example_id, raw_response)."""
    return responses.select("example_id", parse_ratings(F.col("raw_response")).alias("r")).select("example_id", "r.*")


def judge_summary(rows: DataFrame) -> DataFrame:
    """Counts and the mean of each dimension over the ok rows."""
    ok = F.col("status") == "ok"
    n_ok = F.count_if(ok)
    return rows.agg(
        F.when(n_ok > 0, "ok").otherwise("all_failed").alias("status"),
        n_ok.alias("n_scored"),
        F.count(F.lit(1)).alias("n_total"),
        *[F.avg(F.when(ok, F.col(d).cast("double"))).alias(f"mean_{d}") for d in RATING_DIMENSIONS],
    )


def rating_pairs(human: DataFrame, judge: DataFrame) -> DataFrame:
    """(dimension, h, j, n): how often each pair of ratings occurs.

    The distinct ratings of a scale are few, so everything after this is small.
    """
    given = judge.select("example_id", *[F.col(d).alias(f"_{d}") for d in RATING_DIMENSIONS])
    cells = [
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("h"), F.col(f"_{d}").cast("double").alias("j"))
        for d in RATING_DIMENSIONS
    ]
    return (
        human.join(given, "example_id")
        .select(F.inline(F.array(*cells)))
        .groupBy("dimension", "h", "j")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def agreement_status(human: DataFrame, judge: DataFrame) -> DataFrame:
    """One row (status, n_examples): ``no_overlapping_examples`` or ``ok``."""
    common = human.join(judge.select("example_id"), "example_id").agg(F.count(F.lit(1)).alias("n_examples"))
    return common.select(F.when(F.col("n_examples") > 0, "ok").otherwise("no_overlapping_examples").alias("status"), "n_examples")


def judge_human_agreement(pairs: DataFrame) -> DataFrame:
    """Exact rate, mean absolute difference, Pearson correlation and kappa per dimension."""
    n, h, j = F.col("n"), F.col("h"), F.col("j")
    total = F.sum(n)
    mean_h, mean_j = F.sum(n * h) / total, F.sum(n * j) / total
    sums = pairs.groupBy("dimension").agg(
        total.alias("n_examples"),
        (F.sum(F.when(h == j, n).otherwise(0)) / total).alias("exact_agreement"),
        (F.sum(n * F.abs(h - j)) / total).alias("mean_absolute_difference"),
        (F.sum(n * h * j) / total - mean_h * mean_j).alias("_cov"),
        (F.sum(n * h * h) / total - mean_h * mean_h).alias("_var_h"),
        (F.sum(n * j * j) / total - mean_j * mean_j).alias("_var_j"),
    )
    varied = (F.col("_var_h") > 1e-12) & (F.col("_var_j") > 1e-12)
    corr = F.when(varied, F.col("_cov") / F.sqrt(F.col("_var_h") * F.col("_var_j")))
    return (
        sums.withColumn("pearson_correlation", corr)
        .drop("_cov", "_var_h", "_var_j")
        .join(weighted_kappa(pairs), "dimension", "left")
    )


def weighted_kappa(pairs: DataFrame) -> DataFrame:
    """Linear-weighted kappa on half-even-rounded ratings, null when undefined.

    The weight of a disagreement is the distance of the two positions in the
    sorted list of ratings that occur, not of the ratings themselves.
    """
    cells = (
        pairs.select("dimension", F.bround("h").cast("int").alias("h"), F.bround("j").cast("int").alias("j"), "n")
        .groupBy("dimension", "h", "j")
        .agg(F.sum("n").alias("n"))
    )
    grouped = cells.groupBy("dimension").agg(
        F.array_sort(F.array_union(F.collect_set("h"), F.collect_set("j"))).alias("scale"),
        F.collect_list(F.struct("h", "j", "n")).alias("cells"),
    )

    def add(total, x):
        return total + x

    def weight(a: Column, b: Column) -> Column:
        return F.abs(F.array_position("scale", a) - F.array_position("scale", b)).cast("double")

    zero = F.lit(0.0)
    observed = F.aggregate(F.transform("cells", lambda c: c["n"] * weight(c["h"], c["j"])), zero, add)
    total = F.aggregate(F.transform("cells", lambda c: c["n"].cast("double")), zero, add)
    # Sum over all pairs of cells = sum over rating pairs of the row and column totals.
    expected = F.aggregate(
        F.transform(
            "cells",
            lambda a: F.aggregate(
                F.transform("cells", lambda b: (a["n"] * b["n"]) * weight(a["h"], b["j"])), zero, add
            ),
        ),
        zero,
        add,
    )
    return grouped.select(
        "dimension", (1.0 - F.try_divide(observed * total, expected)).alias("weighted_kappa")
    )
