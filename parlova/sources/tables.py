"""Parquet, CSV and JSON tables, and the persisted retrieval index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlova.schemas import RATING_DIMENSIONS, validate_columns


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_metrics_json(df: DataFrame, path: str) -> str:
    """Metrics stay DataFrames; one JSON object per row."""
    df.write.mode("overwrite").json(path)
    return path


def complete_golden_rows(golden: DataFrame) -> DataFrame:
    """Annotated rows only; an empty result means the annotation is pending."""
    return golden.na.drop(subset=["gold_intent", "gold_escalate"])


def usable_human_scores(scores: DataFrame) -> DataFrame:
    """All rows when every rating is present, no rows otherwise."""
    validate_columns(scores, RATING_DIMENSIONS)
    has_null = F.lit(False)
    for d in RATING_DIMENSIONS:
        has_null = has_null | F.col(d).isNull()
    n_null = scores.agg(F.count_if(has_null).alias("n")).select("n").scalar()
    return scores.where(n_null == 0)
