"""Reading JSON answers of an external model out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlova.functions.text import strip
from parlova.schemas import ESCALATE, RATING_DIMENSIONS

# The payload used when no JSON can be read.
PARSE_FAILURE_CLAIM = "LLM_JSON_PARSE_FAILURE"
PARSE_FAILURE_REASON = "LLM output could not be parsed as valid JSON."


def _strict_json(text: Column) -> Column:
    """Variant of exactly one JSON value, else null.

    The parser accepts trailing text; inside brackets it must not.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    single = F.try_variant_get(boxed, "$[1]", "variant").isNull()
    return F.when(single, F.try_variant_get(boxed, "$[0]", "variant"))


def _unfence(raw: Column) -> Column:
    text = strip(raw)
    inner = F.regexp_replace(text, r"^`+|`+$", "")
    inner = F.when(F.lower(F.substring(inner, 1, 4)) == "json", F.substring(inner, 5, 2**30)).otherwise(inner)
    return F.when(F.startswith(text, F.lit("```")), inner).otherwise(text)


def extract_json(raw: Column) -> Column:
    """Whole text as JSON, else the span from the first '{' to the last '}'."""
    text = _unfence(raw)
    span = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(_strict_json(text), _strict_json(span))


def parse_payload(raw: Column) -> Column:
    """STRUCT of the drafted answer, with the fixed failure payload if unreadable."""
    v = extract_json(raw)

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", kind)

    ok = F.struct(
        F.lit(True).alias("parsed"),
        field("reply", "string").alias("reply"),
        F.coalesce(field("grounded", "boolean"), F.lit(False)).alias("grounded"),
        F.coalesce(field("confidence", "double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(field("unsupported_claims", "array<string>"), F.array().cast("array<string>")).alias(
            "unsupported_claims"
        ),
        F.coalesce(field("recommended_action", "string"), F.lit(ESCALATE)).alias("recommended_action"),
        field("escalation_reason", "string").alias("escalation_reason"),
    )
    failed = F.struct(
        F.lit(False).alias("parsed"),
        F.lit(None).cast("string").alias("reply"),
        F.lit(False).alias("grounded"),
        F.lit(0.0).alias("confidence"),
        F.array(F.lit(PARSE_FAILURE_CLAIM)).alias("unsupported_claims"),
        F.lit(ESCALATE).alias("recommended_action"),
        F.lit(PARSE_FAILURE_REASON).alias("escalation_reason"),
    )
    return F.when(v.isNull(), failed).otherwise(ok)


def parse_ratings(raw: Column) -> Column:
    """STRUCT(status, one INT per dimension); 'ok' only if all keys are present."""
    v = extract_json(raw)
    values = {d: F.try_variant_get(v, f"$.{d}", "variant") for d in RATING_DIMENSIONS}
    present = F.lit(True)
    for value in values.values():
        present = present & value.isNotNull()
    status = F.when(raw.isNull(), "pending").when(present, "ok").otherwise("error")
    ratings = [
        F.when(present, F.try_variant_get(v, f"$.{d}", "int")).alias(d) for d in RATING_DIMENSIONS
    ]
    return F.struct(status.alias("status"), *ratings)
