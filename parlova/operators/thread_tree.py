"""Reply threads: root, depth, order and the nearest earlier turns of every message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlova.functions.ids import first_valid_id
from parlova.functions.text import clean_text
from parlova.operators.frames import union_all
from parlova.operators.ranking import global_rank
from parlova.operators.skew import hot_keys, lookup_join
from parlova.operators.threads import _first_rows
from parlova.runtime import materialize

CONTEXT_TURNS = 4


def reply_edges(tweets: DataFrame) -> DataFrame:
    """``tweet_id, parent_id, at, seq, link``: the first row of each id, and the message it replies to.

    ``parent_id`` is null where the row names none (``link`` = root) or one that is not in the table (missing); else
    ``link`` is reply. Rows without an id are left out.
    """
    row = F.struct(first_valid_id(F.col("in_response_to_tweet_id")).alias("named"), F.col("created_at_parsed").alias("at"))
    first = tweets.where(F.col("tweet_id").isNotNull()).groupBy("tweet_id").agg(F.min_by(row, "ingest_seq").alias("m"), F.min("ingest_seq").alias("seq"))
    first = materialize(first.select("tweet_id", "m.named", "m.at", "seq"))
    named = first.where("named IS NOT NULL").select("tweet_id", "named")
    known = first.select(F.col("tweet_id").alias("named"), F.lit(True).alias("known"))
    found = lookup_join(named, known, "named", "tweet_id", hot_keys(named, "named")).select("tweet_id", "known")
    link = F.when(F.col("named").isNull(), "root").when(F.col("known"), "reply").otherwise("missing")
    return first.join(found, "tweet_id", "left").select(
        "tweet_id", F.when(F.col("known"), F.col("named")).alias("parent_id"), "at", "seq", link.alias("link")
    )


def _jumped(active: DataFrame, known: DataFrame, turns: int) -> DataFrame:
    """Every pointer moved to where its target points; done where the target is done."""
    nexts = known.select(
        F.col("tweet_id").alias("ptr"),
        F.struct("done", F.col("ptr").alias("to"), "hops", "low", "path").alias("next"),
    )
    joined = lookup_join(active.drop("done"), nexts, "ptr", "tweet_id", hot_keys(active, "ptr"))
    return joined.select(
        "tweet_id",
        F.col("next.to").alias("ptr"),
        (F.col("hops") + F.col("next.hops")).alias("hops"),
        F.least("low", "next.low").alias("low"),
        F.slice(F.concat("path", "next.path"), 1, turns).alias("path") if turns else F.col("path"),
        F.col("next.done").alias("done"),
    )


def thread_roots(edges: DataFrame, turns: int = CONTEXT_TURNS) -> DataFrame:
    """``tweet_id, root_id, depth, path, link`` of every message.

    ``depth`` counts the replies from the root down, ``path`` holds the ids of the ``turns`` nearest earlier messages, the
    nearest first. A message without a parent, or whose parent is missing, is a root. A cycle of replies, one message
    that answers itself included, is cut at its smallest id, which becomes a root with ``link`` = cut.

    Pointers double: after round r a message knows its ancestor 2^r replies up, so a chain of n messages
    takes log2(n) rounds, each one join of the messages that have not reached their root. A round in which
    none arrives leaves only cycles and what hangs on them.
    """
    edges = materialize(edges.select("tweet_id", "parent_id", "link"))
    none = F.array().cast("array<string>")
    is_root = F.col("parent_id").isNull()
    start = edges.select(
        "tweet_id",
        F.coalesce("parent_id", "tweet_id").alias("ptr"),
        F.when(is_root, 0).otherwise(1).cast("bigint").alias("hops"),
        F.coalesce("parent_id", "tweet_id").alias("low"),
        F.when(is_root | F.lit(turns == 0), none).otherwise(F.array("parent_id")).alias("path"),
        is_root.alias("done"),
    )
    done, active = [start.where("done")], start.where("NOT done")
    n_active = active.count()
    while n_active:
        step = materialize(_jumped(active, union_all([*done, active]), turns))
        arrived = step.where("done").count()
        active = step.where("NOT done")
        if arrived:
            done.append(step.where("done"))
            n_active -= arrived
            continue
        # Only cycles are left. Steps as many as messages see a whole cycle, and end on one.
        hops = 2 * active.agg(F.min("hops")).first()[0]
        while hops < 2 * n_active:
            active = materialize(_jumped(active, active, turns))
            hops *= 2
        on_cycle = active.select(F.col("ptr").alias("tweet_id")).distinct()
        cut = active.join(on_cycle, "tweet_id", "left_semi").where("low = tweet_id").select("tweet_id", F.lit(True).alias("cut"))
        left = edges.join(active.select("tweet_id"), "tweet_id", "left_semi").join(cut, "tweet_id", "left")
        reopened = left.select(
            "tweet_id",
            F.when(F.col("cut").isNull(), F.col("parent_id")).alias("parent_id"),
            F.when(F.col("cut"), "cut").otherwise(F.col("link")).alias("link"),
        )
        rest = thread_roots(reopened, turns)
        return _found(done, edges).unionByName(rest)
    return _found(done, edges)


def _found(done: list[DataFrame], edges: DataFrame) -> DataFrame:
    rows = union_all(done).select("tweet_id", F.col("ptr").alias("root_id"), F.col("hops").alias("depth"), "path")
    return rows.join(edges.select("tweet_id", "link"), "tweet_id")


def thread_positions(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``tweet_id, position``: the place of a message in its thread, from 1, by time (unknown last), then read order.

    Ranked over the whole table at once, so one thread may hold any share of the rows.
    """
    placed = materialize(roots.select("tweet_id", "root_id").join(edges.select("tweet_id", "at", "seq"), "tweet_id"))
    ranked = global_rank(placed, [F.col("root_id"), F.col("at").asc_nulls_last(), F.col("seq")], "_rank").rows
    ranked = materialize(ranked)
    first = ranked.groupBy("root_id").agg(F.min("_rank").alias("_first"))
    joined = lookup_join(ranked, first, "root_id", "tweet_id", hot_keys(ranked, "root_id"))
    return joined.select("tweet_id", (F.col("_rank") - F.col("_first") + 1).alias("position"))


def thread_context(tweets: DataFrame, roots: DataFrame, role: Column | None = None) -> DataFrame:
    """``tweet_id, context``: the nearest earlier turns of a message as lines ``role: text``, the oldest first.

    Texts are cleaned and masked; a null text is empty. ``role`` is a column of the tweet, by default customer for
    inbound messages and support for others. A root has an empty context.
    """
    who = F.when(F.col("inbound"), "customer").otherwise("support") if role is None else role
    told = tweets.withColumn("line", F.concat(who, F.lit(": "), clean_text(F.col("text"))))
    turns = materialize(roots.select("tweet_id", F.posexplode("path").alias("back", "target_id")))
    lines = _first_rows(told, turns, "line")
    joined = lookup_join(turns, lines, "target_id", "tweet_id", hot_keys(turns, "target_id"))
    turn = F.struct((-F.col("back")).alias("back"), F.col("target.line").alias("line"))
    folded = joined.groupBy("tweet_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return roots.select("tweet_id").join(folded, "tweet_id", "left").select(
        "tweet_id", F.coalesce(F.array_join(F.col("turns.line"), "\n"), F.lit("")).alias("context")
    )
