"""Queries against their SQL. All of them with PARLOVA_ALL=1, else one of each kind."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from oracle import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
SOME = [
    "scan_tweets_csv", "parse_created_at", "first_valid_id", "mask_pii", "clean_text", "ngram_counts", "dataset_summary",
    "rank_brand_candidates", "reconstruct_pairs", "pair_outcome_counts", "chronological_split", "golden_stratified_sample",
    "golden_set_checks", "leakage_report_planted", "keyword_weak_label", "tfidf_weights", "nearest_centroid", "silhouette_exact",
    "silhouette_fast", "threshold_sweep", "bm25_topk_padded", "cosine_topk", "hybrid_topk", "hybrid_topk_dense", "parse_model_payload",
    "escalation_policy", "triage_messages", "eval_by_system", "escalation_metrics", "reply_similarity", "failure_examples",
    "judge_human_agreement", "comparison_table", "repeated_failure", "thread_roots", "benchmark_containment",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("PARLOVA_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert spark_rows(entry.queries()[name](spark, SF)) == sql_rows(con, entry.oracle_sql()[name])
