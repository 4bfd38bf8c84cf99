"""Weak labels and label statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlova.functions.text import keyword_label
from parlova.schemas import OTHER_INTENT

# Keyword rules, in order of priority.
KEYWORD_RULES = [
    ("PAYMENT_ISSUE", ["payment", "charged", "charge", "billed", "billing"]),
    ("REFUND_REQUEST", ["refund", "money back"]),
    ("LOGIN_OR_ACCOUNT", ["log into", "login", "password", "locked out", "2fa", "two factor"]),
    ("ORDER_OR_TRANSACTION", ["order", "transaction", "processing"]),
    ("DELIVERY_OR_SHIPPING", ["delivered", "shipping", "tracking", "package", "damaged"]),
    ("TECHNICAL_PROBLEM", ["crash", "error code", "broken", "bug"]),
    ("CANCELLATION", ["cancel"]),
    ("PRODUCT_INFORMATION", ["difference between", "discount", "work with", "does your"]),
]


def weak_label(col: Column, rules: list[tuple[str, list[str]]] = KEYWORD_RULES) -> Column:
    return keyword_label(col, rules, OTHER_INTENT)


def cluster_to_intent(df: DataFrame, cluster_col: str, mapping: DataFrame) -> DataFrame:
    """Attach the intent of each cluster; unmapped clusters become OTHER_OR_UNKNOWN.

    ``mapping`` (cluster, intent) has one row per named cluster.
    """
    names = mapping.select(F.col("cluster").alias(cluster_col), F.col("intent").alias("_intent"))
    return (
        df.join(names, cluster_col, "left")
        .withColumn("intent", F.coalesce("_intent", F.lit(OTHER_INTENT)))
        .drop("_intent")
    )


def unmapped_clusters(df: DataFrame, cluster_col: str, mapping: DataFrame) -> DataFrame:
    used = df.select(F.col(cluster_col).alias("cluster")).distinct()
    return used.join(mapping.select("cluster"), "cluster", "left_anti")


def label_distribution(df: DataFrame, label_col: str = "intent") -> DataFrame:
    return df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def majority_label(df: DataFrame, label_col: str = "intent") -> DataFrame:
    """Most frequent label; the smaller name wins a tie."""
    return label_distribution(df, label_col).orderBy(F.col("n").desc(), label_col).limit(1)


def min_class_count(df: DataFrame, label_col: str = "intent") -> DataFrame:
    """Size of the smallest class, and whether 3-fold calibration is possible."""
    return label_distribution(df, label_col).agg(
        F.min("n").alias("min_class_count"), (F.min("n") >= 3).alias("can_calibrate")
    )
