"""The stream of repeated failures against the batch operator: replay, late and repeated rows, expiry."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from parlova.operators import history
from parlova.schemas import OTHER_INTENT
from parlova.streaming.history import EVENT_SCHEMA, _Memory, repeated_failure_stream

START = datetime(2024, 1, 1)
DAY = 86_400_000_000


def run_stream(spark, tmp_path, files, days, checkpoint="check", first=0):
    """Each list of events is one file and one micro-batch."""
    for i, events in enumerate(files, first):
        frame = spark.createDataFrame(events, EVENT_SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        repeated_failure_stream(stream, days)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / checkpoint))
        .option("path", str(tmp_path / "out"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return [(r.customer, r.tweet_id, r.repeated_failure) for r in spark.read.parquet(str(tmp_path / "out")).collect()]


def batch_flags(spark, events, days):
    messages = {e[1]: e for e in events if e[5] is None}
    replies = {}
    for e in events:
        if e[5] is not None and (e[5] not in replies or e[3] < replies[e[5]]):
            replies[e[5]] = e[3]
    contacts = [(e[0], e[2], e[3], replies.get(e[1]), e[4]) for e in messages.values()]
    asked = [(e[4], e[0], e[2], e[3], e[4]) for e in messages.values()]
    earlier = spark.createDataFrame(contacts, "customer string, intent string, opened timestamp, resolved timestamp, seq bigint")
    rows = spark.createDataFrame(asked, "qid bigint, customer string, intent string, sent timestamp, seq bigint")
    flags = {r.qid: r.repeated_failure for r in history.repeated_failures(rows, earlier, days).collect()}
    return {(e[0], e[1], flags[e[4]]) for e in messages.values()}


@pytest.fixture
def two_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_stream_equals_batch_with_repeated_and_late_rows(spark, tmp_path, two_partitions):
    rng = random.Random(5)
    events = []
    for i in range(160):
        at = START + timedelta(minutes=15 * i)
        customer = rng.choice(["hot", "hot", "b", "c"])
        events.append((customer, f"m{i}", rng.choice(["X", "X", "Y", OTHER_INTENT, None]), at, i, None))
        if rng.random() < 0.5:
            events.append((customer, f"r{i}", None, at + timedelta(minutes=rng.choice([0, 15, 45, 600])), 1000 + i, f"m{i}"))
    events.sort(key=lambda e: e[3])
    # Within the hour of delay rows come in any order; some come twice.
    files = []
    for low in range(0, len(events), 60):
        part = events[low : low + 60]
        shuffled = [part[i : i + 4] for i in range(0, len(part), 4)]
        for few in shuffled:
            rng.shuffle(few)
        files.append([e for few in shuffled for e in few] + part[-2:])
    files[1] += files[0][:5]
    # Far behind the watermark: dropped. Far ahead: lets all others pass.
    files[-1] += [("b", "late", "X", START, 5000, None)]
    files.append([("end", "end", "X", START + timedelta(days=90), 9000, None)])
    got = run_stream(spark, tmp_path, files, 1)
    assert len(got) == len(set(got)) and not any(t in ("late", "end") for _, t, _ in got)
    want = batch_flags(spark, events, 1)
    assert set(got) == want and 10 < sum(f for *_, f in want) < len(want) - 10
    # Started again from its checkpoint with nothing new, it adds nothing.
    assert sorted(run_stream(spark, tmp_path, [], 1)) == sorted(got)


def test_memory_orders_expires_and_forgets():
    def event(*e):
        import pandas as pd

        frame = pd.DataFrame([e], columns=["tweet_id", "at", "answers", "seq", "intent"])
        return frame.assign(at=pd.to_datetime(frame["at"], unit="us"))

    m = _Memory(None)
    m.add(event("a", 10, None, 1, "X"))
    m.add(event("a", 10, None, 1, "X"))
    m.add(event("b", 10, None, 2, "X"))
    m.add(event("r", 20, "a", 3, None))
    m.add(event("s", 20, "b", 4, None))
    m.add(event("c", 20, None, 5, "X"))
    m = _Memory(m.text())
    assert m.pass_to(11, DAY) == [("a", 1, False), ("b", 2, True)]
    assert m.pass_to(21, DAY) == [("c", 5, False)]
    assert [c[3] for c in m.open] == ["c"]
    m.add(event("d", 20 + DAY, None, 6, "X"))
    m.add(event("e", 22 + DAY * 2, None, 7, "X"))
    assert m.pass_to(3 * DAY, DAY) == [("d", 6, True), ("e", 7, False)]
    assert m.pass_to(4 * DAY, DAY) == [] and m.open == [] and m.answered == {} and m.next_time() is None
