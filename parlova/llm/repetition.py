"""Quality rules on repetition, from a suffix array over the words of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlova.llm.arrays import Texts, codes, covered, per_text, pieces, words
from parlova.llm.suffixes import permuted_lcp, repeat_length, suffix_array

MIN_WORDS = 50
WINDOW = 3
MAX_WINDOW_PERCENT = 50
# The method's own limits: repeats of REPEAT_WORDS words or more, the share of words they
# may cover, and the words the longest may have as a share of the text.
REPEAT_WORDS = 10
MAX_COVERED = 0.20
MAX_LONGEST = 0.20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_covered_words bigint, longest_repeat bigint"
)


def _equal_lines(texts: Texts, word_start: np.ndarray) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    breaks = np.flatnonzero(texts.data == 0x0A)
    start = np.sort(np.concatenate([texts.offsets[:-1], breaks + 1]))
    start = np.unique(start[start < len(texts.data)])
    end = np.append(start[1:], len(texts.data))[: len(start)]
    # A line ends before its break; the last of a text has none.
    ended = texts.data[end - 1] == 0x0A
    end = end - ended
    has_word = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
    start, end = start[has_word], end[has_word]
    owner = np.searchsorted(texts.offsets, start, "right") - 1
    key = owner.astype(np.int64) * (len(start) + 1) + codes(texts.data, start, end)
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(start), bool)
    again[first] = False
    return np.bincount(owner[again], minlength=len(texts))


def measure(texts: Texts, window: int = WINDOW, repeat_words: int = REPEAT_WORDS) -> dict[str, np.ndarray]:
    """The figures of each text of a piece."""
    found = words(texts)
    n_words = np.diff(found.first)
    leads = (texts.data & 0xC0) != 0x80
    in_word = np.concatenate([[0], np.cumsum(leads, dtype=np.int64)])
    chars = in_word[found.end] - in_word[found.start]
    value = codes(texts.data, found.start, found.end)
    order = suffix_array(value, found.text)
    longest = repeat_length(order, permuted_lcp(value, found.text, order))
    n = len(value)
    short = np.flatnonzero(longest >= window)
    long_ = np.flatnonzero(longest >= repeat_words)
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, found.text, longest)
    return {
        "n_words": n_words,
        "word_chars": per_text(chars, found.first),
        "n_symbols": per_text(_SYMBOL[texts.data], texts.offsets),
        "n_dup_lines": _equal_lines(texts, found.start),
        "n_repeat_words": per_text(covered(short, np.full(len(short), window), n), found.first),
        "n_covered_words": per_text(covered(long_, longest[long_], n), found.first),
        "longest_repeat": top,
    }


def repetition_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat_words: int = REPEAT_WORDS) -> DataFrame:
    """Word, symbol, line and repetition figures per row.

    The suffix array of a text's words gives each place the longest word sequence that starts
    there and elsewhere too; the maximal sequences are the intervals of its common prefixes.
    Their union is ``n_covered_words`` (sequences of ``repeat_words`` or more) and
    ``n_repeat_words`` (of three). Null and empty texts give zeros; every row is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for texts in pieces(batch.column(1)):
                found = measure(texts, WINDOW, repeat_words)
                own = ids.slice(texts.rows.start, len(texts))
                yield pa.record_batch([own, *(pa.array(v.astype(np.int64)) for v in found.values())], names=["doc_id", *found])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def judge(
    stats: DataFrame,
    min_words: int = MIN_WORDS,
    max_window_percent: int = MAX_WINDOW_PERCENT,
    max_covered: float = MAX_COVERED,
    max_longest: float = MAX_LONGEST,
) -> DataFrame:
    """Adds ``base_failed`` and ``kept``."""
    n = F.col("n_words")
    base = (n < min_words) | (100 * F.col("n_repeat_words") > max_window_percent * n)
    fair = (F.col("n_covered_words") <= max_covered * n) & (F.col("longest_repeat") <= F.greatest(max_longest * n, F.lit(REPEAT_WORDS)))
    return stats.withColumn("base_failed", base).withColumn("kept", ~base & fair)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows whose own text passes, all columns as they came.

    Rows are judged one by one, so repeated and null ids need no care. A table without rows
    gives none.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(0).field(text_col)):
                found = measure(texts)
                row = batch.column(0).slice(texts.rows.start, len(texts))
                yield pa.record_batch([row, *(pa.array(v.astype(np.int64)) for v in found.values())], names=["_row", *found])

    kind = rows.schema["_row"].dataType.simpleString()
    measured = rows.mapInArrow(run, f"_row {kind}, {SCHEMA.removeprefix('doc_id bigint, ')}")
    return judge(measured, **limits).where("kept").select("_row.*")


def op10_repetition(spark, sf_dir: str) -> DataFrame:
    """Figures and verdict for all ``documents``."""
    return judge(repetition_stats(spark.read.parquet(f"{sf_dir}/documents.parquet")))
