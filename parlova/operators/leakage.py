"""Leakage between the golden set, the splits and the retrieval corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlova.functions.ids import row_digest
from parlova.functions.text import space_tokens
from parlova.operators.evaluate import PENDING
from parlova.operators.golden import prediction_columns
from parlova.runtime import materialize


def cross_split_duplicates(splits: DataFrame, text_col: str = "cleaned_text") -> DataFrame:
    """Texts that occur in more than one split, with the number of splits."""
    per_split = splits.where(F.col(text_col).isNotNull()).select(text_col, "split").distinct()
    return (
        per_split.groupBy(text_col)
        .agg(F.count(F.lit(1)).alias("n_splits"))
        .where(F.col("n_splits") > 1)
    )


def shared_texts(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> DataFrame:
    """Distinct texts present in both tables; ``a`` is the smaller one.

    The larger table is filtered by the smaller, so it is not shuffled when the
    smaller one fits a broadcast.
    """
    small = a.select(F.col(a_col).alias("text")).where(F.col("text").isNotNull()).select(row_digest("text").alias("_d")).distinct()
    large = b.select(F.col(b_col).alias("text")).where(F.col("text").isNotNull()).withColumn("_d", row_digest("text"))
    return large.join(small, "_d", "left_semi").select("text").distinct()


# Words of the window by which items and documents meet.
WINDOW_WORDS = 8


def contained_items(items: DataFrame, documents: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """``item_id, doc_id``: which documents contain the whole text of an item, as a sequence of words.

    ``items`` (item_id, text), ``documents`` (doc_id, text). Words are taken between white space, in lower case. Every
    item is looked for by a hash of its first ``width`` words (all, if it has fewer) among the hashes of the
    documents' windows of as many words; only hashes and places move. Places that meet are verified word by word in
    the documents that have any. A pair comes once, however often the text or the rows repeat; null ids and
    items without a word match nothing.
    """
    def of_words(rows: DataFrame, key: str) -> DataFrame:
        return rows.where(F.col(key).isNotNull()).select(key, space_tokens(F.lower(F.coalesce("text", F.lit("")))).alias("words"))

    def window_hash(words: Column, start: Column, n: Column) -> Column:
        return F.xxhash64(F.array_join(F.slice(words, start, n), " "))

    n = F.least(F.size("words"), F.lit(width))
    wanted = of_words(items, "item_id").where(F.size("words") > 0).dropDuplicates()
    wanted = materialize(wanted.select("item_id", F.col("words").alias("item_words"), n.alias("n"), window_hash(F.col("words"), F.lit(1), n).alias("hash")))
    # Each length of a window that occurs, at most ``width`` of them.
    sizes = sorted(r.n for r in wanted.select("n").distinct().collect())
    if not sizes:
        return wanted.select("item_id").limit(0).withColumn("doc_id", F.lit(None).cast(documents.schema["doc_id"].dataType))
    placed = of_words(documents, "doc_id").where(F.size("words") >= sizes[0])

    def places(words: Column, size: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - size + 1)
        return F.transform(
            starts, lambda at: F.struct(F.lit(size).alias("n"), window_hash(words, at, F.lit(size)).alias("hash"), at.alias("at"))
        )

    none = F.array().cast("array<struct<n: int, hash: bigint, at: int>>")
    windows = F.concat(*[F.when(F.size("words") >= size, places(F.col("words"), size)).otherwise(none) for size in sizes])
    met = placed.select("doc_id", F.inline(windows)).join(wanted.select("item_id", "n", "hash"), ["n", "hash"])
    met = materialize(met.select("doc_id", "item_id", "at").distinct())
    texts = placed.join(met.select("doc_id").distinct(), "doc_id", "left_semi")
    found = met.join(texts, "doc_id").join(wanted.select("item_id", "item_words"), "item_id")
    same = F.slice("words", F.col("at"), F.size("item_words")) == F.col("item_words")
    return found.where(same).select("item_id", "doc_id").distinct()


def _size(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()


def leakage_report(
    golden: DataFrame | None,
    splits: DataFrame | None,
    index_corpus: DataFrame | None,
    text_col: str = "cleaned_text",
) -> DataFrame:
    """(check, passed, n_overlap, status).

    An absent input leaves its check null. The status is FAIL with any failed
    check, PARTIAL_PENDING with any null one, else PASS. Without a golden set nothing can be
    checked: the one row has no check and the status of a pending annotation.
    """
    if golden is None:
        none = F.lit(None)
        return SparkSession.active().range(1).select(
            none.cast("string").alias("check"),
            none.cast("boolean").alias("passed"),
            none.cast("bigint").alias("n_overlap"),
            F.lit(PENDING).alias("status"),
        )
    overlaps: dict[str, Column] = {}
    none = F.lit(None).cast("bigint")
    if splits is None:
        overlaps["golden_not_in_train"] = none
        overlaps["no_cross_split_duplicates"] = none
    else:
        train = splits.where(F.col("split") == "train")
        overlaps["golden_not_in_train"] = _size(shared_texts(golden, "customer_text", train, text_col))
        overlaps["no_cross_split_duplicates"] = _size(cross_split_duplicates(splits, text_col))
    overlaps["golden_not_in_retrieval_index"] = (
        none
        if index_corpus is None
        else _size(shared_texts(golden, "customer_text", index_corpus, "customer_text"))
    )
    overlaps["golden_labels_not_derived_from_predictions"] = F.lit(len(prediction_columns(golden))).cast("bigint")
    rows = [F.struct(F.lit(k).alias("check"), v.alias("n_overlap")) for k, v in overlaps.items()]
    checks = F.col("checks")
    status = (
        F.when(F.exists(checks, lambda c: c["n_overlap"] > 0), "FAIL")
        .when(F.exists(checks, lambda c: c["n_overlap"].isNull()), "PARTIAL_PENDING")
        .otherwise("PASS")
    )
    one = golden.sparkSession.range(1).select(F.array(*rows).alias("checks"))
    return one.select(status.alias("status"), F.inline("checks")).select(
        "check", (F.col("n_overlap") == 0).alias("passed"), "n_overlap", "status"
    )
