"""Earlier contacts of a customer: which messages come back to an issue that is still open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlova.functions.ids import first_valid_id
from parlova.runtime import materialize
from parlova.schemas import OTHER_INTENT

FAILURE_DAYS = 14


def running_max(rows: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds ``out``, the largest ``value`` of the earlier rows of the same keys; null before the first one.

    Rows are dealt by ranges of keys and order, so that the rows of one key may lie in many parts. Each
    part keeps its own running value; what a key brings from its earlier parts is one row per part that it
    goes on in, fewer rows than there are parts. ``order_by`` must be total within a key, and ``rows``
    should be a stored table: it is read once more to find the ranges.
    """
    placed = materialize(rows.repartitionByRange(*keys, *order_by).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy("_part", *keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy(*keys, "_part").agg(F.max(value).alias("_end"))
    brought = ends.withColumn("_brought", F.max("_end").over(parts)).where(F.col("_brought").isNotNull()).drop("_end")
    return (
        placed.withColumn("_own", F.max(value).over(earlier))
        .join(F.broadcast(brought), [*keys, "_part"], "left")
        .withColumn(out, F.greatest("_own", "_brought"))
        .drop("_own", "_brought", "_part")
    )


def contacts(tweets: DataFrame, intent: Column, brand: str | None = None) -> DataFrame:
    """``tweet_id, customer, intent, opened, resolved, seq`` of every customer message, the first row of an id.

    A contact is resolved when the first reply that names it is sent, by ``brand`` if one is given; a reply
    without a readable time resolves nothing.
    """
    row = F.struct("inbound", F.col("author_id").alias("customer"), intent.alias("intent"), F.col("created_at_parsed").alias("opened"))
    first = tweets.groupBy("tweet_id").agg(F.min_by(row, "ingest_seq").alias("m"), F.min("ingest_seq").alias("seq"))
    support = tweets.where(~F.col("inbound"))
    if brand is not None:
        support = support.where(F.col("author_id") == brand)
    answered = (
        support.select(first_valid_id(F.col("in_response_to_tweet_id")).alias("tweet_id"), "created_at_parsed")
        .where("tweet_id IS NOT NULL AND created_at_parsed IS NOT NULL")
        .groupBy("tweet_id")
        .agg(F.min("created_at_parsed").alias("resolved"))
    )
    return (
        first.where("m.inbound")
        .select("tweet_id", "m.customer", "m.intent", "m.opened", "seq")
        .join(answered, "tweet_id", "left")
        .select("tweet_id", "customer", "intent", "opened", "resolved", "seq")
    )


def repeated_failures(messages: DataFrame, earlier: DataFrame, days: int = FAILURE_DAYS) -> DataFrame:
    """``qid, repeated_failure`` for every message (``qid, customer, intent, sent, seq``).

    True when the customer opened a contact on the same intent (``earlier``: ``customer, intent, opened,
    resolved, seq``) before the message, at most ``days`` days ago, that was still unresolved when the message came.
    Of equal times the smaller ``seq`` is earlier, so a message that is a contact too does not count against
    itself. A contact is open until it is resolved or too old, whatever comes first, so a message looks
    for the latest such end among all earlier contacts: one running maximum, no pairs of rows. Unknown
    customers, intents and times match nothing and give false.
    """
    known = "customer IS NOT NULL AND intent IS NOT NULL AND at IS NOT NULL AND intent <> '" + OTHER_INTENT + "'"
    kind = messages.schema["qid"].dataType
    # The first moment at which the contact no longer counts.
    until = F.least("resolved", F.col("opened") + F.expr(f"INTERVAL {days} DAYS") + F.expr("INTERVAL 0.000001 SECONDS"))
    asked = messages.select("qid", "customer", "intent", F.col("sent").alias("at"), "seq")
    opened = earlier.select(
        F.lit(None).cast(kind).alias("qid"), "customer", "intent", F.col("opened").alias("at"), "seq", until.alias("until")
    )
    events = asked.withColumn("until", F.lit(None).cast(opened.schema["until"].dataType)).withColumn("is_contact", F.lit(0))
    events = events.unionByName(opened.withColumn("is_contact", F.lit(1))).where(known)
    running = running_max(materialize(events), ["customer", "intent"], ["at", "seq", "is_contact", "qid"], "until", "open_until")
    found = running.where("is_contact = 0").select("qid", F.coalesce(F.col("open_until") > F.col("at"), F.lit(False)).alias("repeated_failure"))
    rest = asked.where(f"NOT coalesce({known}, false)").select("qid", F.lit(False).alias("repeated_failure"))
    return found.unionByName(rest)
