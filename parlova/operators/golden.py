"""Quality checks on an annotated golden set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlova.functions.text import strip
from parlova.schemas import AUTO_HANDLE, ESCALATE, REASON_CODES

# Allowed size, rare-intent limit.
MIN_ROWS, MAX_ROWS = 150, 250
MIN_PER_INTENT = 3


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (strip(F.col(name)) == "")


def _extra_rows(df: DataFrame, col: str) -> Column:
    """Rows beyond the first of each value, as a scalar."""
    groups = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select("n").scalar()


def _unknown_values(df: DataFrame, col: str, allowed: DataFrame) -> Column:
    """Distinct values of ``col`` missing from ``allowed``, as a scalar."""
    present = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    bad = present.join(allowed.toDF("value"), "value", "left_anti")
    return bad.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()


def golden_set_checks(
    golden: DataFrame, intents: DataFrame, min_rows: int = MIN_ROWS, max_rows: int = MAX_ROWS
) -> DataFrame:
    """(check, n_bad, passed, severity); only failed checks of severity error fail the set."""
    spark = golden.sparkSession
    escalated = golden.where(F.col("gold_escalate") == ESCALATE)
    with_reason = escalated.where(~_blank("gold_escalation_reason"))
    counts = golden.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(_blank("gold_intent")).alias("missing_gold_intent"),
        F.count_if(_blank("gold_escalate")).alias("missing_gold_escalate"),
        F.count_if((F.col("gold_escalate") == ESCALATE) & _blank("gold_escalation_reason")).alias(
            "escalation_without_reason"
        ),
    )
    rare = (
        golden.where(F.col("gold_intent").isNotNull())
        .groupBy("gold_intent")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") < MIN_PER_INTENT).alias("n"))
    )
    decisions = spark.createDataFrame([(AUTO_HANDLE,), (ESCALATE,)], "value string")
    reasons = spark.createDataFrame([(c,) for c in REASON_CODES], "value string")
    n_rows = F.col("n_rows")
    checks: list[tuple[str, Column, str]] = [
        ("duplicate_example_id", _extra_rows(golden, "example_id"), "error"),
        ("duplicate_customer_text", _extra_rows(golden, "customer_text"), "error"),
        ("size_out_of_range", F.when(n_rows.between(min_rows, max_rows), 0).otherwise(n_rows), "error"),
        ("missing_gold_intent", F.col("missing_gold_intent"), "error"),
        ("missing_gold_escalate", F.col("missing_gold_escalate"), "error"),
        ("unknown_intent_value", _unknown_values(golden, "gold_intent", intents.select("name")), "error"),
        ("unknown_decision_value", _unknown_values(golden, "gold_escalate", decisions), "error"),
        ("escalation_without_reason", F.col("escalation_without_reason"), "error"),
        ("unknown_reason_code", _unknown_values(with_reason, "gold_escalation_reason", reasons), "error"),
        ("rare_intent", rare.select("n").scalar(), "warning"),
    ]
    rows = [
        F.struct(F.lit(name).alias("check"), n.cast("bigint").alias("n_bad"), F.lit(sev).alias("severity"))
        for name, n, sev in checks
    ]
    return (
        counts.select(F.inline(F.array(*rows)))
        .withColumn("passed", F.col("n_bad") == 0)
        .select("check", "n_bad", "passed", "severity")
    )


def golden_completion(golden: DataFrame) -> DataFrame:
    """Rows, and the share of them with an intent, in percent."""
    return golden.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (100.0 * F.try_divide(F.count("gold_intent"), F.count(F.lit(1)))).alias("completion_pct"),
    )


def golden_set_passes(checks: DataFrame) -> Column:
    """Aggregate expression: no failed check of severity error."""
    return F.count_if(~F.col("passed") & (F.col("severity") == "error")) == 0


def prediction_columns(golden: DataFrame) -> list[str]:
    """Columns that would show gold labels came from predictions. Starts no job."""
    return [c for c in golden.columns if c.startswith("pred_")]
