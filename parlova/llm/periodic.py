"""Periodic runs of words, found on a grammar of each text, and texts without their repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlova.llm.arrays import Texts, Words, codes, pieces, words
from parlova.llm.recompression import common_extension, grammar

MIN_LENGTH = 6
MIN_EXPONENT = 4
# Grid places handled at once; bounds memory for a text of any length.
_CHUNK = 1 << 21

WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _grid(n_words: np.ndarray, first: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of every grid place, in bounded chunks.

    A run of period q and length exponent * q or more holds a place x that is a multiple of
    (exponent - 1) * q and whose partner x + q is in the run too. Periods go up to n / exponent, so the
    grids of a text of n words have about n log(n) / (exponent - 1) places.
    """
    most = n_words // exponent
    total = int(most.sum())
    text = np.repeat(np.arange(len(most)), most)
    period = np.arange(total) - np.repeat(np.cumsum(most) - most, most) + 1
    step = period * max(1, exponent - 1)
    count = (n_words[text] - period - 1) // step + 1
    ends = np.cumsum(count)
    low = 0
    while low < total:
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + _CHUNK, "right")))
        own = count[low:high]
        nth = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        which = np.repeat(np.arange(low, high), own)
        yield first[text[which]] + nth * step[which], period[which]
        low = high


def runs_of(value: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    ``value`` numbers the words of consecutive texts, text t has the places first[t]:first[t + 1].
    A run is a stretch that no neighbouring word extends keeping its smallest period q, of at least
    ``min_length`` words and ``exponent`` (two or more) times q.
    """
    n_words = np.diff(first)
    n_texts = len(n_words)
    # A closing symbol before the first text and behind each one.
    text = np.repeat(np.arange(n_texts), n_words)
    place = np.arange(len(value)) + text + 1
    closed = np.empty(len(value) + n_texts + 1, np.int64)
    closed[place] = value + n_texts + 1
    closed[np.concatenate([[0], first[1:] + np.arange(1, n_texts + 1)])] = np.arange(n_texts + 1)
    forward = grammar(closed, n_texts + 1)
    backward = forward.mirrored()
    found = [np.zeros((0, 3), np.int64)]
    for x, q in _grid(n_words, first, exponent):
        keep = value[x] == value[x + q]
        x, q = x[keep], q[keep]
        at = place[x]
        ahead = common_extension(forward, at, at + q)
        # Places before x, mirrored: the mirror image of place i - 1 is len - i.
        behind = common_extension(backward, len(closed) - at, len(closed) - at - q)
        length = ahead + behind + q
        good = length >= np.maximum(min_length, exponent * q)
        found.append(np.stack([x[good] - behind[good], length[good], q[good]], axis=1))
    rows = np.concatenate(found)
    # A stretch also answers for multiples of its smallest period.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    owner = np.searchsorted(first, rows[:, 0], "right") - 1
    return np.stack([owner, rows[:, 0] - first[owner], rows[:, 1], rows[:, 2]], axis=1)


def _collapsed(texts: Texts, found: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts without the words behind a run's first period."""
    change = np.zeros(len(found.start) + 1, np.int64)
    low = found.first[rows[:, 0]] + rows[:, 1]
    np.add.at(change, low + rows[:, 3], 1)
    np.add.at(change, low + rows[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    start, text = found.start[kept], found.text[kept]
    last = np.ones(len(kept), bool)
    last[:-1] = text[1:] != text[:-1]
    # A word and a space behind it, but for the last of a text.
    size = found.end[kept] - start + ~last
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    source = np.arange(total) + np.repeat(start - (ends - size), size)
    out = texts.data[np.minimum(source, max(0, len(texts.data) - 1))]
    out[ends[~last] - 1] = 0x20
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.add.at(offsets, text + 1, size)
    return out, np.cumsum(offsets)


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row.

    ``runs`` lists the periodic runs of the words by start, then period; ``collapsed`` is the text, one
    space between words, without the words that a run holds after its first period. Words are compared
    as they are written. Null and empty texts have no word, no run and an empty ``collapsed``; repeated
    ids and rows stay apart, a null id stays null, a table without rows gives none, and only the two
    named columns are read. Texts are handled whole, a few MB of them or one long text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for texts in pieces(batch.column(1)):
                found = words(texts)
                rows = runs_of(codes(texts.data, found.start, found.end), found.first, min_length, exponent)
                bounds = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
                one = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in (1, 2, 3)], names=["start", "length", "period"])
                data, offsets = _collapsed(texts, found, rows)
                text = pa.Array.from_buffers(
                    pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
                )
                yield pa.record_batch(
                    [
                        ids.slice(texts.rows.start, len(texts)),
                        pa.array(np.diff(found.first).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds), one),
                        text.cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def planted(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, in about a tenth of the rows made periodic from a place that the id tells.

    With h the CRC-32 of the decimal id and g = floor(h / 10): where h % 10 = 0, each word i >= a becomes
    word a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)) for n words. A null id,
    or a text without words, leaves the text as it is.
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("bigint").cast("string").cast("binary"))
    g = F.floor(h / 10)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    word = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def changed(found: Column) -> Column:
        n = F.size(found)
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        moved = F.transform(
            found, lambda w, i: F.when(i < a, w).otherwise(F.get(found, (a + (i - a) % p).cast("int")))
        )
        return F.when(n > 0, F.array_join(moved, " ")).otherwise(text)

    # An array of one word list, so that the list is made once.
    return F.when(h % 10 == 0, F.get(F.transform(F.array(word), changed), F.lit(0))).otherwise(text)


def op11_periodic(spark, sf_dir: str) -> DataFrame:
    """Runs and collapsed texts of all ``documents``, as figures and digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", planted().alias("text")))
    # The first of the greatest: runs come by start, then period.
    best = F.get(F.filter("runs", lambda r: r["length"] == F.array_max(F.transform("runs", lambda s: s["length"]))), F.lit(0))
    lines = F.transform(
        "runs",
        lambda r: F.concat(
            F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")
        ),
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
