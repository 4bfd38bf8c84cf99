"""Repeated failures on a stream: open contacts are remembered per customer and expire."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlova.operators.history import FAILURE_DAYS
from parlova.schemas import OTHER_INTENT

# A message of a customer has no ``answers``; a reply names the message it answers there.
EVENT_SCHEMA = "customer string, tweet_id string, intent string, at timestamp, seq bigint, answers string"
_OUT = "customer string, tweet_id string, seq bigint, repeated_failure boolean"
_MICROS_PER_DAY = 86_400_000_000


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


class _Memory:
    """What is kept of one customer.

    ``waiting`` are events that the watermark has not passed, by id, so a redelivered one is held once;
    ``open`` contacts [intent, time, until, tweet_id] no older than the window; ``answered`` first reply times of them.
    """

    def __init__(self, text: str | None):
        kept = json.loads(text) if text else {}
        self.waiting: dict[str, list[Any]] = kept.get("waiting", {})
        self.open: list[list[Any]] = kept.get("open", [])
        self.answered: dict[str, int] = kept.get("answered", {})

    def text(self) -> str:
        return json.dumps({"waiting": self.waiting, "open": self.open, "answered": self.answered})

    def add(self, events: pd.DataFrame) -> None:
        rows = zip(events["tweet_id"], _micros(events["at"]), events["answers"], events["seq"], events["intent"])
        for tweet_id, at, answers, seq, intent in rows:
            self.waiting.setdefault(tweet_id, [at, answers, int(seq), intent])

    def pass_to(self, watermark: int, window: int) -> list[tuple[str, int, bool]]:
        """Take the events before the watermark in their order; (tweet_id, seq, flag) of the messages."""
        ready = sorted(
            ((at, answers is None, seq, tweet_id, answers, intent) for tweet_id, (at, answers, seq, intent) in self.waiting.items() if at < watermark)
        )
        out = []
        # Of equal times replies come first: what they resolve is not open any more.
        for at, is_message, seq, tweet_id, answers, intent in ready:
            del self.waiting[tweet_id]
            if not is_message:
                self.answered.setdefault(answers, at)
                continue
            known = intent is not None and intent != OTHER_INTENT
            out.append((tweet_id, seq, known and any(self._is_open(c, intent, at) for c in self.open)))
            if known:
                self.open.append([intent, at, at + window + 1, tweet_id])
        self.open = [c for c in self.open if c[2] > watermark and self.answered.get(c[3], watermark) >= watermark]
        self.answered = {i: at for i, at in self.answered.items() if at > watermark - window - 1}
        return out

    def _is_open(self, contact: list[Any], intent: str, at: int) -> bool:
        return contact[0] == intent and contact[2] > at and self.answered.get(contact[3], at + 1) > at

    def next_time(self) -> int | None:
        """When something happens next: an event is due, or a contact expires."""
        times = [e[0] for e in self.waiting.values()] + [c[2] for c in self.open]
        return min(times) if times else None


def repeated_failure_stream(events: DataFrame, days: int = FAILURE_DAYS, delay: str = "1 hour") -> DataFrame:
    """``customer, tweet_id, seq, repeated_failure`` for every customer message of a stream (EVENT_SCHEMA).

    As ``operators.history.repeated_failures`` tells of the whole table: events wait until the watermark, ``delay``
    behind the newest time, has passed them and are then taken by time, replies first, then ``seq``. An event older than
    the watermark comes too late and is dropped, and so is one delivered again: once passed it is too late, before
    that it is held by its id. A contact is forgotten when it is answered or ``days`` days old, a customer
    without waiting events and open contacts altogether. Rows without customer, id or time are left out.
    """
    window = days * _MICROS_PER_DAY

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = _Memory(state.get[0] if state.exists else None)
        for batch in batches:
            if not state.hasTimedOut:
                memory.add(batch)
        watermark_ms = state.getCurrentWatermarkMs()
        found = memory.pass_to(watermark_ms * 1000, window)
        due = memory.next_time()
        if due is None and not memory.answered:
            if state.exists:
                state.remove()
        else:
            state.update((memory.text(),))
            # With answers alone there is nothing to wait for but their end.
            due = due if due is not None else max(memory.answered.values()) + window + 1
            state.setTimeoutTimestamp(max(due // 1000 + 1, watermark_ms + 1))
        if found:
            yield pd.DataFrame(
                [(key[0], tweet_id, seq, flag) for tweet_id, seq, flag in found],
                columns=["customer", "tweet_id", "seq", "repeated_failure"],
            )

    return (
        events.where("customer IS NOT NULL AND tweet_id IS NOT NULL AND at IS NOT NULL")
        .withWatermark("at", delay)
        .groupBy("customer")
        .applyInPandasWithState(run, _OUT, "memory string", "append", GroupStateTimeout.EventTimeTimeout)
    )
