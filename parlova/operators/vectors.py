"""TF-IDF as long tables (doc_id, gram, weight)."""

from collections.abc import Callable
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlova.functions.text import ngrams


# Characters of the texts that one task takes apart: it holds a counter per text and gram.
TASK_CHARS = 4 << 20


def _by_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts dealt by id over as many tasks as their length asks for; merging small parts by bytes would not see the grams."""
    texts = docs.select(id_col, text_col)
    chars = texts.agg(F.sum(F.length(text_col))).first()[0] or 0
    return texts.repartition(1 + chars // TASK_CHARS, id_col)


def gram_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_n: int = 2) -> DataFrame:
    """Occurrences of each word and word pair per text.

    Texts are distributed by id before they are taken apart: that moves less than
    the grams would, and counting (and later norms) per text needs no shuffle.
    """
    return (
        _by_id(docs, id_col, text_col)
        .select(id_col, F.explode(ngrams(F.col(text_col), max_n)).alias("gram"))
        .groupBy(id_col, "gram")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


@dataclass(frozen=True)
class Vocabulary:
    """``terms`` (gram, df, idf): at most ``max_features`` rows, so it may be broadcast."""

    terms: DataFrame
    max_features: int


def fit_vocabulary(
    n_docs: int,
    counts: DataFrame,
    max_features: int = 5000,
    min_df: int = 1,
) -> Vocabulary:
    """The most frequent grams (ties by gram) with smoothed idf = ln((1+n)/(1+df)) + 1."""
    totals = counts.groupBy("gram").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    return choose_vocabulary(n_docs, totals, max_features, min_df)


def choose_vocabulary(n_docs: int, totals: DataFrame, max_features: int = 5000, min_df: int = 1) -> Vocabulary:
    """As ``fit_vocabulary``, from (gram, total, df)."""
    terms = (
        totals.where(F.col("df") >= min_df)
        .orderBy(F.col("total").desc(), "gram")
        .limit(max_features)
        .select("gram", "df", (F.log(F.lit(n_docs + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    )
    return Vocabulary(terms, max_features)


def tfidf_weights(counts: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id") -> DataFrame:
    """L2-normalised tf·idf of the vocabulary grams; keeps ``df`` for the retrieval plan."""
    terms = F.broadcast(vocabulary.terms)
    raw = counts.join(terms, "gram").withColumn("_x", F.col("tf") * F.col("idf"))
    # A text has at most max_features rows here, so the per-text window is bounded.
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "gram", (F.col("_x") / norm).alias("w"), "df")


def with_encoder(df: DataFrame, text_col: str, load_encoder: Callable[[], Callable], out: str = "vec") -> DataFrame:
    """Add dense vectors of an own sentence encoder.

    ``load_encoder`` runs once per Python worker and returns a function from a
    list of texts to a 2-d array; batches arrive through Arrow.
    """

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load_encoder()
        for texts in batches:
            yield pd.Series(list(np.asarray(encoder(texts.fillna("").tolist()), dtype=float)))

    return df.withColumn(out, encode(F.col(text_col)))
