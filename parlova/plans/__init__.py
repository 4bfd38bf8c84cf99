"""All registered queries."""

from parlova.plans import data_plans, eval_plans, model_plans, retrieval_plans, triage_plans  # noqa: F401
from parlova.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
