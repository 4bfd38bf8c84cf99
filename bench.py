"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR (default sf0.1) names the tables, BENCH_CPUS (default 8) the cores,
BENCH_QUERIES (comma-separated) another choice of queries.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from parlova import plans
from parlova.runtime import build_session

HEADLINE = [
    "clean_text",
    "mask_pii",
    "tokenize_terms",
    "ngram_counts",
    "dataset_summary",
    "duplicate_counts",
    "rank_brand_candidates",
    "reconstruct_pairs",
    "pair_outcome_counts",
    "golden_stratified_sample",
    "chronological_split",
    "leakage_report",
    "keyword_weak_label",
    "tfidf_weights",
    "nearest_centroid",
    "cluster_representatives",
    "silhouette_exact",
    "silhouette_fast",
    "build_index_postings",
    "bm25_topk",
    "tfidf_cosine_topk",
    "cosine_topk",
    "hybrid_topk",
    "linear_score_softmax",
    "threshold_sweep",
    "escalation_policy",
    "triage_messages",
    "eval_by_system",
    "reply_similarity",
    "judge_human_agreement",
    "failure_examples",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "parlova-bench",
        master=f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="/tmp/run-"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    all_queries = plans.queries()
    spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
    times: dict[str, float] = {}
    for name in chosen:
        started = time.perf_counter()
        all_queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
