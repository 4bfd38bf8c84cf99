"""The escalation policy as one expression over signal columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlova.functions.text import first_keyword
from parlova.schemas import AUTO_HANDLE, ESCALATE, OTHER_INTENT

# Keyword lists and thresholds.
SENSITIVE_PHRASES = [
    "delete my account",
    "close my account",
    "change my email",
    "change my password to",
    "transfer ownership",
]
HIGH_RISK_KEYWORDS = [
    "chargeback",
    "lawsuit",
    "fraud",
    "unauthorized charge",
    "delete my account",
    "close my account",
    "legal action",
]
MIN_GROUNDING_SCORE = 0.35


def escalation_decision(
    message: Column,
    intent: Column,
    confidence: Column,
    top_score: Column,
    grounded: Column,
    unsupported_claims: Column,
    conflicting_history: Column,
    repeated_failure: Column | None = None,
    confidence_threshold: float = 0.60,
    min_score: float = MIN_GROUNDING_SCORE,
    high_risk_keywords: list[str] | None = None,
    sensitive_phrases: list[str] | None = None,
) -> Column:
    """STRUCT(decision, reason_code, reason); the first rule that matches decides.

    Unknown signals never auto-handle: a null intent counts as unknown, a null or NaN
    confidence as too low, a null or NaN retrieval score as no history, a null grounding flag
    as false. A null message has no keyword. Optional history flags count as false when null.
    """
    known_confidence = F.nanvl(confidence.cast("double"), F.lit(None).cast("double"))
    known_score = F.nanvl(top_score.cast("double"), F.lit(None).cast("double"))
    repeated = F.lit(False) if repeated_failure is None else F.coalesce(repeated_failure, F.lit(False))
    sensitive = first_keyword(message, SENSITIVE_PHRASES if sensitive_phrases is None else sensitive_phrases)
    risky = first_keyword(message, HIGH_RISK_KEYWORDS if high_risk_keywords is None else high_risk_keywords)
    rules: list[tuple[Column, str, Column]] = [
        (F.coalesce(intent, F.lit(OTHER_INTENT)) == OTHER_INTENT, "UNKNOWN_INTENT", F.lit("The message could not be mapped to a known intent.")),
        (
            F.coalesce(known_confidence < confidence_threshold, F.lit(True)),
            "LOW_INTENT_CONFIDENCE",
            F.coalesce(
                F.when(
                    known_confidence.isNotNull(),
                    F.format_string(f"Intent confidence %.2f is below {confidence_threshold:.2f}.", known_confidence),
                ),
                F.lit("The intent confidence is unknown."),
            ),
        ),
        (
            sensitive.isNotNull(),
            "SENSITIVE_ACCOUNT_ACTION",
            F.concat(F.lit("Sensitive account action: "), sensitive),
        ),
        (risky.isNotNull(), "HIGH_RISK_REQUEST", F.concat(F.lit("High-risk keyword: "), risky)),
        (repeated, "REPEATED_FAILURE", F.lit("An earlier contact on this issue stayed unresolved.")),
        (
            F.coalesce(conflicting_history, F.lit(False)),
            "CONFLICTING_HISTORY",
            F.lit("The best historical replies disagree."),
        ),
        (
            F.coalesce(known_score < min_score, F.lit(True)),
            "NO_RELEVANT_HISTORY",
            F.lit("No similar resolved case was found."),
        ),
        (
            ~F.coalesce(grounded, F.lit(False)) | (F.coalesce(F.size(unsupported_claims), F.lit(0)) > 0),
            "UNSUPPORTED_INFORMATION",
            F.lit("The draft is not fully supported by historical replies."),
        ),
    ]
    auto = F.struct(
        F.lit(AUTO_HANDLE).alias("decision"),
        F.lit(None).cast("string").alias("reason_code"),
        F.lit(None).cast("string").alias("reason"),
    )
    chain = None
    for condition, code, reason in rules:
        outcome = F.struct(
            F.lit(ESCALATE).alias("decision"), F.lit(code).alias("reason_code"), reason.alias("reason")
        )
        chain = F.when(condition, outcome) if chain is None else chain.when(condition, outcome)
    return chain.otherwise(auto)


def reason_code_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision", "reason_code").agg(F.count(F.lit(1)).alias("n"))
