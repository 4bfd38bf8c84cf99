"""Dense vectors of texts: a truncated singular value decomposition of their TF-IDF weights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlova.operators.vectors import Vocabulary, gram_counts, tfidf_weights
from parlova.runtime import materialize

RANK = 32
OVERSAMPLING = 8
POWER_ROUNDS = 4
_SEED = 7


@dataclass(frozen=True)
class LsaModel:
    """``grams`` in order; ``components`` (gram, rank) with orthonormal columns; ``singular`` values, falling."""

    vocabulary: Vocabulary
    grams: list[str]
    components: np.ndarray
    singular: np.ndarray


def _compact(weights: DataFrame, grams: DataFrame, key: str) -> DataFrame:
    """``key, idx, w``: the weights of a text as two arrays, by place in the vocabulary."""
    entry = F.struct("idx", F.col("w").cast("double").alias("w"))
    folded = weights.join(F.broadcast(grams), "gram").groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return folded.select(key, F.col("entries.idx").alias("idx"), F.col("entries.w").alias("w"))


def _flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, weights, first entry of each text) of texts with an entry."""
    first = np.concatenate([[0], np.cumsum([len(x) for x in batch["idx"]])])[:-1]
    return np.concatenate(list(batch["idx"])).astype(int), np.concatenate(list(batch["w"])), first


def _scatter(docs: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A^T (A basis) for the texts A: each task sums over its texts and returns a row per gram, vocabulary-sized."""
    n, width = basis.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, width))
        for batch in batches:
            if batch.empty:
                continue
            idx, w, first = _flat(batch)
            projected = np.add.reduceat(w[:, None] * basis[idx], first, axis=0)
            per_entry = np.repeat(projected, np.diff(np.append(first, len(idx))), axis=0)
            np.add.at(total, idx, w[:, None] * per_entry)
        some = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"idx": some, "row": list(total[some])})

    parts = docs.select("idx", "w").mapInPandas(run, "idx int, row array<double>")
    summed = parts.groupBy("idx").agg(F.array(*[F.sum(F.get("row", F.lit(c))) for c in range(width)]).alias("row"))
    out = np.zeros((n, width))
    # One row per gram of the vocabulary, which is bounded.
    for r in summed.collect():
        out[r.idx] = r.row
    return out


def fit_lsa(weights: DataFrame, vocabulary: Vocabulary, rank: int = RANK, rounds: int = POWER_ROUNDS) -> LsaModel:
    """Leading right singular vectors of TF-IDF weights (``doc_id, gram, w``; a stored table).

    Randomised range finding: a random basis of ``rank`` + OVERSAMPLING columns is multiplied by A^T A ``rounds`` times,
    orthonormalised in between; the last product gives the singular values within its range. Each round
    is one pass over the texts, and only tables of vocabulary size leave the tasks. The largest component of each
    vector, the first in gram order if several, is positive. Rank is at most the number of grams; directions without
    weight are left out; without texts there are none.
    """
    terms = vocabulary.terms.select("gram").orderBy("gram").limit(vocabulary.max_features).collect()
    grams = [r.gram for r in terms]
    if not grams:
        return LsaModel(vocabulary, [], np.zeros((0, 0)), np.zeros(0))
    places = weights.sparkSession.createDataFrame(list(enumerate(grams)), "idx int, gram string")
    docs = materialize(_compact(weights, places, "doc_id"))
    width = min(len(grams), rank + OVERSAMPLING)
    basis = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((len(grams), width)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(_scatter(docs, basis))[0]
    inner = basis.T @ _scatter(docs, basis)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values)[:rank]
    order = order[values[order] > 1e-12 * max(1.0, values.max())]
    components = basis @ vectors[:, order]
    size = np.round(np.abs(components), 9)
    largest = components[size.argmax(axis=0), np.arange(len(order))] if len(order) else np.zeros(0)
    return LsaModel(vocabulary, grams, components * np.where(largest < 0, -1.0, 1.0), np.sqrt(values[order]))


def lsa_vectors(weights: DataFrame, model: LsaModel, key: str = "doc_id") -> DataFrame:
    """``key, vec``: texts (``key, gram, w``) in the directions of the model; texts without a known gram are absent."""
    places = weights.sparkSession.createDataFrame(list(enumerate(model.grams)), "idx int, gram string")
    components = model.components

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                idx, w, first = _flat(batch)
                yield pd.DataFrame({key: batch[key], "vec": list(np.add.reduceat(w[:, None] * components[idx], first, axis=0))})

    kind = weights.schema[key].dataType.simpleString()
    return _compact(weights, places, key).mapInPandas(run, f"{key} {kind}, vec array<double>")


def text_vectors(texts: DataFrame, model: LsaModel, key: str = "qid") -> DataFrame:
    """``key, vec`` for every text (``key, text``); zero where no gram is known."""
    weights = tfidf_weights(gram_counts(texts, key, "text"), model.vocabulary, key)
    zero = F.array(*[F.lit(0.0) for _ in range(model.components.shape[1])]).cast("array<double>")
    found = lsa_vectors(weights, model, key)
    return texts.select(key).join(found, key, "left").select(key, F.coalesce("vec", zero).alias("vec"))
