"""Threads and earlier contacts against plain versions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parlova.operators import history, skew, thread_tree
from parlova.schemas import OTHER_INTENT

TWEETS = (
    "tweet_id string, author_id string, inbound boolean, text string, in_response_to_tweet_id string, "
    "created_at_parsed timestamp, ingest_seq bigint"
)
START = datetime(2024, 1, 1)


def tweets_of(spark, rows):
    return spark.createDataFrame(rows, TWEETS)


def plain_threads(rows, turns):
    """{id: (root, depth, path, link)} by walking up from every message."""
    first = {}
    for r in sorted(rows, key=lambda r: r[6]):
        if r[0] is not None:
            first.setdefault(r[0], r)
    named = {i: ((r[4] or "").strip().split(",")[0].strip() or None) if (r[4] or "").strip().lower() != "nan" else None for i, r in first.items()}
    link = {i: "root" if p is None else "reply" if p in first else "missing" for i, p in named.items()}
    parent = {i: p for i, p in named.items() if link[i] == "reply"}
    for start in first:
        seen, at = [], start
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at in seen:
            low = min(seen[seen.index(at) :])
            del parent[low]
            link[low] = "cut"
    out = {}
    for i in first:
        path, at = [], i
        while at in parent:
            at = parent[at]
            path.append(at)
        out[i] = (at, len(path), path[:turns], link[i])
    return out


def got_threads(spark, rows, turns):
    edges = thread_tree.reply_edges(tweets_of(spark, rows))
    found = thread_tree.thread_roots(edges, turns).collect()
    assert len(found) == len({r.tweet_id for r in found})
    return {r.tweet_id: (r.root_id, r.depth, r.path, r.link) for r in found}


@pytest.mark.parametrize("seed,turns", [(1, 4), (2, 1), (3, 0)])
def test_random_forests_with_cycles(spark, seed, turns):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        parent = rng.choice([None, "", "nan", "999", f"{rng.randrange(120)}", f"{max(0, i - 1)}", f"{i - 1},7", f" {rng.randrange(120)} "])
        rows.append((str(i), "a", True, f"t{i}", parent, START, i))
    rows += [("5", "b", True, "again", "6", START, 500), (None, "b", True, "no id", "5", START, 501)]
    assert got_threads(spark, rows, turns) == plain_threads(rows, turns)


def test_a_chain_of_ten_thousand_and_long_circles(spark, monkeypatch):
    """Rounds follow the logarithm of the depth; a cycle is cut at its smallest id."""
    rounds = []
    jumped = thread_tree._jumped
    monkeypatch.setattr(thread_tree, "_jumped", lambda *a: rounds.append(1) or jumped(*a))
    n = 10_000
    rows = [(f"c{i:05d}", "a", True, "x", f"c{i - 1:05d}" if i else None, START, i) for i in range(n)]
    got = got_threads(spark, rows, 3)
    assert len(rounds) <= 15
    assert all(got[f"c{i:05d}"][:2] == ("c00000", i) for i in range(n))
    assert got["c09999"][2] == ["c09998", "c09997", "c09996"]
    ring = [(f"r{i}", "a", True, "x", f"r{(i + 1) % 50}", START, i) for i in range(50)]
    ring += [("tail0", "a", True, "x", "r7", START, 90), ("tail1", "a", True, "x", "tail0", START, 91), ("self", "a", True, "x", "self", START, 92)]
    assert got_threads(spark, ring, 2) == plain_threads(ring, 2)


def test_most_replies_to_one_message(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 50)
    rows = [("0", "a", True, "top", None, START, 0)] + [(str(i), "b", False, f"r{i}", "0" if i % 10 else str(i - 1), START, i) for i in range(1, 1500)]
    assert got_threads(spark, rows, 2) == plain_threads(rows, 2)


def test_positions_and_context(spark):
    rows = [
        ("1", "c", True, "first @you a@b.co", None, START, 1),
        ("2", "s", False, "second  http://x.y", "1", START + timedelta(minutes=1), 2),
        ("3", "c", True, None, "2", None, 3),
        ("4", "s", False, "fourth", "3", START + timedelta(minutes=1), 4),
        ("5", "c", True, "other", "77", START, 5),
    ]
    tweets = tweets_of(spark, rows)
    edges = thread_tree.reply_edges(tweets)
    roots = thread_tree.thread_roots(edges, 2)
    assert {r.tweet_id: r.position for r in thread_tree.thread_positions(roots, edges).collect()} == {"1": 1, "2": 2, "4": 3, "3": 4, "5": 1}
    got = {r.tweet_id: r.context for r in thread_tree.thread_context(tweets, roots).collect()}
    told = got["2"]
    assert told.startswith("customer: first") and "@you" not in told
    assert got == {"1": "", "2": told, "3": f"{told}\nsupport: second", "4": "support: second\ncustomer: ", "5": ""}
    empty = tweets.limit(0)
    none = thread_tree.reply_edges(empty)
    assert thread_tree.thread_roots(none).collect() == [] and thread_tree.thread_positions(thread_tree.thread_roots(none), none).collect() == []


def plain_repeated(messages, contacts, days):
    out = {}
    for qid, customer, intent, sent, seq in messages:
        out[qid] = any(
            customer is not None and sent is not None and intent not in (None, OTHER_INTENT) and (c[0], c[1]) == (customer, intent)
            and c[2] is not None and (c[2], c[4]) < (sent, seq) and sent <= c[2] + timedelta(days=days) and (c[3] is None or c[3] > sent)
            for c in contacts
        )
    return out


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 40), (3, 7)])
def test_repeated_failures_match_plain_version(spark, monkeypatch, seed, partitions):
    rng = random.Random(seed)
    contacts, messages = [], []
    for seq in range(900):
        customer = rng.choice(["hot"] * 6 + ["a", "b", None])
        intent = rng.choice(["X", "X", "Y", OTHER_INTENT, None])
        opened = rng.choice([None] + [START + timedelta(hours=rng.randrange(0, 24 * 60, 3))] * 12)
        resolved = rng.choice([None, START + timedelta(hours=rng.randrange(24 * 70)), opened])
        contacts.append((customer, intent, opened, resolved, seq))
        if seq % 2:
            messages.append((seq, customer, intent, opened, seq))
    # Exactly at the limits: as many days old, resolved at the same moment, equal times.
    for i, (resolved, sent) in enumerate([(None, 3), (None, 4), (START + timedelta(days=1), 1), (None, 0)]):
        contacts.append((f"edge{i}", "X", START, resolved, 2000 + i))
        messages.append((5000 + i, f"edge{i}", "X", START + timedelta(days=sent), 3000 + i if sent else 1000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        asked = spark.createDataFrame(messages, "qid bigint, customer string, intent string, sent timestamp, seq bigint")
        earlier = spark.createDataFrame(contacts, "customer string, intent string, opened timestamp, resolved timestamp, seq bigint")
        got = history.repeated_failures(asked, earlier, 3).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(got) == len(messages)
    want = plain_repeated(messages, contacts, 3)
    assert {r.qid: r.repeated_failure for r in got} == want
    assert [want[5000 + i] for i in range(4)] == [True, False, False, False]
    assert 20 < sum(want.values()) < len(want) - 20


def test_a_hot_customer_is_split(spark):
    """One key lies in several parts, and what it brings from one to the next is at most a row per part."""
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), ((F.col("id") * 7919) % 20_011).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = rows.repartitionByRange("k", "t").withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in placed.groupBy("p").count().collect()]
        got = {r.t: r.best for r in history.running_max(rows, ["k"], ["t"], "v", "best").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 4 and max(sizes) < 8000
    best = None
    for t in range(20_000):
        assert got[t] == best
        v = t * 7919 % 20_011
        best = v if best is None else max(best, v)


def test_contacts_and_triage_flag(spark):
    rows = [
        ("1", "c", True, "refund", None, START, 1),
        ("1", "c", True, "repeated row", None, START + timedelta(days=9), 9),
        ("2", "c", True, "refund", None, START + timedelta(days=1), 2),
        ("3", "s", False, "a", "1,4", START + timedelta(days=5), 3),
        ("4", "s", False, "b", "1", START + timedelta(days=4), 4),
        ("5", "t", False, "c", "2", None, 5),
    ]
    tweets = tweets_of(spark, rows)
    found = {r.tweet_id: (r.customer, r.opened, r.resolved, r.seq) for r in history.contacts(tweets, F.lit("X")).collect()}
    assert found == {"1": ("c", START, START + timedelta(days=4), 1), "2": ("c", START + timedelta(days=1), None, 2)}
    assert {r.tweet_id: r.resolved for r in history.contacts(tweets, F.lit("X"), "t").collect()} == {"1": None, "2": None}
