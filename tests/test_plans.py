"""Physical plans: what must and must not appear."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parlova.functions import text as tx
from parlova.operators import brands, profile, ranking, retrieval, sampling, threads
from parlova.sources import views

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _no_python(plan: str) -> None:
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_text_functions_stay_in_the_jvm(spark):
    docs = views.table(spark, SF, "documents")
    c = F.col("text")
    plan = _plan(docs.select(tx.clean_text(c), tx.ngrams(c), tx.length_bucket(c), tx.first_keyword(c, ["a", "b"])))
    _no_python(plan)
    assert "Exchange" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = _plan(profile.mask_profile(views.table(spark, SF, "documents"), "text", "lang"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"text", "lang"}


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "tweets")
    views.tweets(spark, SF).write.parquet(path)
    plan = _plan(threads._replies_with_target(spark.read.parquet(path), "brand_1"))
    assert "EqualTo(author_id,brand_1)" in plan


def test_author_stats_need_one_shuffle(spark):
    assert _plan(brands.author_stats(views.tweets(spark, SF))).count("Exchange hashpartitioning") == 1


def test_global_rank_never_gathers_the_rows(spark):
    rows = ranking.global_rank(views.tweets(spark, SF).select("ingest_seq", "author_id"), ["ingest_seq"]).rows
    plan = _plan(rows)
    assert "SinglePartition" not in plan and "Window" not in plan


def test_split_is_a_projection_of_the_ranked_rows(spark):
    plan = _plan(sampling.chronological_split(views.pairs(spark, SF)))
    assert "SinglePartition" not in plan and "Exchange hashpartitioning" not in plan


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    assert "WindowGroupLimit" in _plan(ranking.top_k(df, ["g"], [F.col("id")], 2))


def test_no_cartesian_products(spark):
    splits = views.flow(spark, SF)[1]
    index = retrieval.build_index(retrieval.index_corpus(splits))
    hits = retrieval.hybrid_topk(views.messages_of(splits).select("qid", "text"), index, 5)
    plan = _plan(hits)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    _no_python(plan)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "decision" in df.columns


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - set(entry.queries())) or ["none"])
def test_every_sql_has_a_query(name):
    assert name == "none"
