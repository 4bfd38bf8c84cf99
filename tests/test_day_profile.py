"""States per day and batch: merging equals a rescan, replayed batches count once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from parlova.operators import day_profile as dp

SCHEMA = "tweet_id string, author_id string, inbound boolean, created_at string, text string, created_at_parsed timestamp, part int"


def _rows(n):
    start = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        when = None if i % 17 == 0 else start + dt.timedelta(hours=i % 90)
        text = None if i % 13 == 0 else "x" * (i * 7919 % 500)
        out.append((str(i % 900), f"a{i % 70}" if i % 11 else None, i % 3 == 0, "", text, when, i % 5))
    return out


def _exact(merged):
    drop = ["ids", "authors", "lengths"]
    return sorted(map(tuple, merged.drop(*drop).collect()), key=str)


def test_union_equals_rescan(spark):
    rows = spark.createDataFrame(_rows(1200), SCHEMA)
    parts, whole = dp.day_states(rows, F.col("part")), dp.day_states(rows, F.lit(0))
    assert _exact(dp.merge_states(parts, "day")) == _exact(dp.merge_states(whole, "day"))
    days = dp.merge_states(parts, "day")
    assert _exact(dp.merge_states(days)) == _exact(dp.merge_states(whole))
    one = dp.report(dp.merge_states(days)).first()
    assert one.n_rows == 1200 and one.n_texts == sum(r[4] is not None for r in _rows(1200))
    assert abs(one.distinct_ids - 900) <= 900 * dp.DISTINCT_ERROR
    assert abs(one.distinct_authors - 70) <= 70 * dp.DISTINCT_ERROR
    lengths = sorted(len(r[4]) for r in _rows(1200) if r[4] is not None)
    for name, q in dp.QUANTILES.items():
        value, n = one[f"length_{name}"], len(lengths)
        assert sum(v < value for v in lengths) <= n * (q + dp.RANK_ERROR)
        assert sum(v <= value for v in lengths) >= n * (q - dp.RANK_ERROR)


def test_batches_are_replaced_and_added(spark, tmp_path):
    rows = spark.createDataFrame(_rows(300), SCHEMA)
    path = str(tmp_path / "states")
    dp.write_states(dp.day_states(rows.where("part < 3"), F.col("part")), path)
    dp.write_states(dp.day_states(rows.where("part >= 2"), F.col("part")), path)
    dp.write_states(dp.day_states(rows.where("part = 0"), F.col("part")), path)
    stored = dp.read_states(spark, path)
    assert _exact(dp.merge_states(stored, "day")) == _exact(dp.merge_states(dp.day_states(rows, F.lit(1)), "day"))


def test_nulls_and_empty_tables(spark):
    blank = spark.createDataFrame([(None,) * 6 + (0,)] * 2, SCHEMA)
    one = dp.report(dp.merge_states(dp.day_states(blank, F.lit(0)), "day")).first()
    assert (one.day, one.n_rows, one.null_text, one.distinct_ids, one.n_texts, one.length_p50) == (None, 2, 2, 0, 0, None)
    empty = dp.day_states(blank.limit(0), F.lit(0))
    assert dp.merge_states(empty, "day").count() == 0
