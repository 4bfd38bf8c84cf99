"""Table schemas and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Required columns of the raw message table.
TWEET_COLUMNS = [
    "tweet_id",
    "author_id",
    "inbound",
    "created_at",
    "text",
    "response_tweet_id",
    "in_response_to_tweet_id",
]

# Every field is read as text: ids must not be inferred as numbers, and the
# flag and the timestamp are normalised afterwards.
TWEET_CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TWEET_COLUMNS])

# Intents, decisions, reason codes, rating dimensions.
OTHER_INTENT = "OTHER_OR_UNKNOWN"
INTENTS = [
    "PAYMENT_ISSUE",
    "REFUND_REQUEST",
    "LOGIN_OR_ACCOUNT",
    "ORDER_OR_TRANSACTION",
    "DELIVERY_OR_SHIPPING",
    "TECHNICAL_PROBLEM",
    "CANCELLATION",
    "PRODUCT_INFORMATION",
    "OTHER_OR_UNKNOWN",
]
AUTO_HANDLE = "AUTO_HANDLE"
ESCALATE = "ESCALATE"
REASON_CODES = [
    "LOW_INTENT_CONFIDENCE",
    "NO_RELEVANT_HISTORY",
    "UNSUPPORTED_INFORMATION",
    "SENSITIVE_ACCOUNT_ACTION",
    "CONFLICTING_HISTORY",
    "UNKNOWN_INTENT",
    "REPEATED_FAILURE",
    "HIGH_RISK_REQUEST",
]
RATING_DIMENSIONS = ["groundedness", "relevance", "correctness", "helpfulness", "tone", "overall"]

INTENT_DIM_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("inclusion_rules", T.ArrayType(T.StringType())),
        T.StructField("exclusion_rules", T.ArrayType(T.StringType())),
        T.StructField("examples", T.ArrayType(T.StringType())),
    ]
)


class SchemaError(ValueError):
    """The input table lacks required columns."""


def validate_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Check column names only; extra columns pass through. Starts no job."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaError(f"missing required columns: {missing}; found: {df.columns}")
    return df


def intent_dimension(spark: SparkSession, rows: list[dict] | None = None) -> DataFrame:
    """The intent table; without rows, the fixed names with empty rules."""
    if rows is None:
        rows = [{"name": n} for n in INTENTS]
    data = [
        (
            r["name"],
            r.get("description"),
            list(r.get("inclusion_rules", [])),
            list(r.get("exclusion_rules", [])),
            list(r.get("examples", [])),
        )
        for r in rows
    ]
    return spark.createDataFrame(data, INTENT_DIM_SCHEMA)
