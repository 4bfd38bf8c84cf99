"""The given tables in the shapes the operators expect.

Every view reads whole tables. ``plans.sqlviews`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlova.functions.ids import row_digest
from parlova.operators.labels import weak_label
from parlova.operators.sampling import chronological_split, golden_candidates, stratified_sample
from parlova.operators.threads import reconstruct_pairs, with_text_fields
from parlova.runtime import discard, materialize, scratch_scope
from parlova.schemas import TWEET_COLUMNS
from parlova.sources.tweets import normalize_tweets

BASE_SECONDS = 1704067200
# The annotated share of the pairs, one in so many, at every table size.
GOLDEN_SHARE = 4

# The texts of replies are joined to their pairs in so many turns.
REPLY_PARTS = 4

# The given texts are invented, so the rules look for strings that occur in them.
VIEW_RULES = [
    ("PAYMENT_ISSUE", ["ción", "mente"]),
    ("REFUND_REQUEST", ["eaux", "aire"]),
    ("LOGIN_OR_ACCOUNT", ["keit", "schaft"]),
    ("ORDER_OR_TRANSACTION", ["tionand", "thering"]),
    ("DELIVERY_OR_SHIPPING", ["blean", "ndhe"]),
    ("TECHNICAL_PROBLEM", ["stre", "whth"]),
    ("CANCELLATION", ["lyer"]),
    ("PRODUCT_INFORMATION", ["erou", "onin"]),
]
VIEW_RISKY = ["andthe", "tionti", "entre"]
VIEW_SENSITIVE = ["lyly", "stst"]


# A number that varies with both the conversation and the turn in a row number.
MIXED_SQL = "(pair_seq // 1000 * 7 + pair_seq % 1000 * 13)"


def mixed(seq: Column) -> Column:
    return F.floor(seq / 1000) * 7 + seq % 1000 * 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with text flags, text times, comma lists, blank and repeated ids."""
    c = table(spark, sf_dir, "conversations")
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    is_user = role == "user"
    seconds = F.lit(BASE_SECONDS) + ((conv * 37) % 1000) * 3600 + turn * 60
    when = F.concat(
        F.date_format(F.timestamp_seconds(seconds), "EEE MMM dd HH:mm:ss"),
        F.lit(" +0000 "),
        F.date_format(F.timestamp_seconds(seconds), "yyyy"),
    )
    previous = (conv * 1000 + turn - 1).cast("string")
    mark = conv * 7 + turn
    copies = F.when(is_user & (conv % 29 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return c.withColumn("copy", F.explode(copies)).select(
        (conv * 1000 + turn).cast("string").alias("tweet_id"),
        F.when(F.col("copy") == 1, "cust_copy")
        .when(is_user, F.concat(F.lit("cust_"), (conv % 97).cast("string")))
        .when(role == "assistant", F.concat(F.lit("brand_"), (conv % 3).cast("string")))
        .otherwise("system")
        .alias("author_id"),
        F.when(is_user, F.element_at(F.array(F.lit("True"), F.lit(" TRUE "), F.lit("true")), (conv % 3 + 1).cast("int")))
        .when(role == "system", "no")
        .otherwise("False")
        .alias("inbound"),
        F.when(conv % 53 == 0, "not a date").otherwise(when).alias("created_at"),
        "text",
        F.when(is_user, (conv * 1000 + turn + 1).cast("string")).alias("response_tweet_id"),
        F.when(
            role == "assistant",
            F.when(mark % 41 == 0, "")
            .when(mark % 50 == 0, F.concat(previous, F.lit(",999999")))
            .when(mark % 61 == 0, "nan")
            .when(mark % 67 == 0, "77")
            .otherwise(previous),
        ).alias("in_response_to_tweet_id"),
        (conv * 1000 + turn + F.col("copy") * F.lit(10**15)).alias("ingest_seq"),
    )


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_tweets(raw_tweets(spark, sf_dir))


def linked_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages with replies by customers too, some circles of replies, and some answers to themselves."""
    number = F.col("tweet_id").cast("bigint")
    conv, turn = F.floor(number / 1000), number % 1000
    named = (
        F.when((conv % 11 == 0) & (turn == 0), (number + 3).cast("string"))
        .when((conv % 13 == 1) & (turn == 2), F.col("tweet_id"))
        .when(F.col("inbound") & (turn > 0), (number - 1).cast("string"))
        .otherwise(F.col("in_response_to_tweet_id"))
    )
    return tweets(spark, sf_dir).withColumn("in_response_to_tweet_id", named)


def plain_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the columns of the message schema."""
    return tweets(spark, sf_dir).select(*TWEET_COLUMNS, "created_at_parsed")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_from(tweets(spark, sf_dir))


def pairs_from(tweet_rows: DataFrame) -> DataFrame:
    return with_text_fields(reconstruct_pairs(tweet_rows)).withColumn("intent", weak_label(F.col("cleaned_text"), VIEW_RULES))


def _gold_columns(seq: Column) -> dict[str, Column]:
    escalate = F.when(seq % 13 == 0, F.lit(None)).when(seq % 19 == 0, "MAYBE").when(seq % 3 == 0, "ESCALATE").otherwise("AUTO_HANDLE")
    return {
        "gold_intent": F.when(seq % 11 == 0, F.lit(None)).when(seq % 17 == 0, "BOGUS_INTENT").otherwise(F.col("intent")),
        "gold_escalate": escalate,
        "gold_escalation_reason": F.when(
            escalate == "ESCALATE",
            F.when(seq % 5 == 0, F.lit(None)).when(seq % 7 == 0, "BOGUS_CODE").otherwise("HIGH_RISK_REQUEST"),
        ),
    }


def golden_from(pair_rows: DataFrame) -> DataFrame:
    """An annotated quarter of the pairs with planted defects; qid is the pair's row number."""
    sample = stratified_sample(pair_rows, pair_rows.count() // GOLDEN_SHARE)
    sample = sample.select("conversation_id", "pair_seq", "intent", "cleaned_text", "raw_text")
    return golden_candidates(sample, keep=("pair_seq", "intent")).select(
        "example_id",
        "customer_text",
        "context",
        F.col("pair_seq").alias("qid"),
        *[c.alias(n) for n, c in _gold_columns(F.col("pair_seq")).items()],
    )


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(golden_from(pairs(spark, sf_dir)))


def splits_from(pair_rows: DataFrame, golden_rows: DataFrame) -> DataFrame:
    return chronological_split(pair_rows, golden_texts=golden_rows.select("customer_text"))


def flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(golden, splits): the golden set and the remaining pairs, split by time.

    Replies, most of the text, are known by their digest until the split is known, and then move once.
    """
    tweet_rows = tweets(spark, sf_dir)
    digest = F.hex(row_digest("text"))
    # The raw text of these pairs is the customer's, so it is stored once.
    raw = F.col("customer_text")
    marked = tweet_rows.withColumn("text", F.when(F.col("inbound"), F.col("text")).otherwise(digest))
    pair_rows = materialize(pairs_from(marked).drop("raw_text"))
    with scratch_scope(spark) as keep:
        golden_rows = keep(golden_from(pair_rows.withColumn("raw_text", raw)))
    with scratch_scope(spark) as keep:
        splits = splits_from(pair_rows, golden_rows)
        # The ranked rows of the split are a table of their own.
        discard(pair_rows)
        replies = tweet_rows.where("NOT inbound").select(F.col("ingest_seq").alias("pair_seq"), digest.alias("_digest"), "text")
        splits = keep(*_with_replies(splits, replies))
    return golden_rows, splits.withColumn("raw_text", raw)


def _with_replies(splits: DataFrame, replies: DataFrame) -> list[DataFrame]:
    """The splits with their replies' texts in place of the digests, in REPLY_PARTS parts by row number.

    Row numbers may repeat, with other texts too: a reply is told by its number and digest. Pairs have a number.
    """
    part = F.pmod(F.xxhash64("pair_seq"), F.lit(REPLY_PARTS))
    texts = replies.select("pair_seq", F.col("_digest").alias("support_text"), F.col("text").alias("_text"))
    return [
        splits.where(part == i)
        .join(texts.where(part == i).dropDuplicates(["pair_seq", "support_text"]), ["pair_seq", "support_text"])
        .withColumn("support_text", F.col("_text"))
        .select(*splits.columns)
        for i in range(REPLY_PARTS)
    ]


def messages_of(splits: DataFrame, split: str = "test") -> DataFrame:
    """Messages to answer: (qid, message, text, intent)."""
    return splits.where(F.col("split") == split).select(
        F.col("pair_seq").alias("qid"),
        F.col("customer_text").alias("message"),
        F.col("cleaned_text").alias("text"),
        "intent",
        "customer_tweet_id",
    )


def training_rows(splits: DataFrame) -> DataFrame:
    return splits.where(F.col("split") == "train").select(
        F.col("pair_seq").alias("doc_id"), F.col("cleaned_text").alias("text"), "intent"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, vec ARRAY<DOUBLE>, label)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


def ratings(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Ratings 1..5 per labelled document, for a judge or a human."""
    d = F.col("doc_id")
    q = F.col("quality")
    base = {
        "groundedness": 1 + d % 5,
        "relevance": 1 + (d * 3 + q) % 5,
        "correctness": F.when(d % 4 == 0, 5).otherwise(2 + q),
        "helpfulness": 1 + (d + F.col("toxic")) % 2 * 3,
        "tone": F.lit(4),
        "overall": 1 + (d * 7) % 4,
    }
    shift = {"groundedness": 3, "relevance": 4, "correctness": 5, "helpfulness": 2, "tone": 6, "overall": 7}
    lab = table(spark, sf_dir, "labels")
    if side == "judge":
        cols = {n: F.when(d % shift[n] == 0, F.least(v + 1, F.lit(5))).otherwise(v) for n, v in base.items()}
        status = F.when(d % 9 == 0, "error").otherwise("ok")
        return lab.select(
            d.cast("string").alias("example_id"),
            status.alias("status"),
            *[F.when(status == "ok", c).cast("int").alias(n) for n, c in cols.items()],
        )
    return lab.select(d.cast("string").alias("example_id"), *[c.cast("int").alias(n) for n, c in base.items()])
