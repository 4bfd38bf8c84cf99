"""SimHash near duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlova.llm.arrays import joined, pieces, words
from parlova.llm.components import connected_components, stars
from parlova.runtime import materialize

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 3
_CHUNK = 1 << 16


def _bit_majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text the 64 bits set in more than half of its hashes."""
    n = len(first) - 1
    counts = np.zeros((n, 64), np.int64)
    for low in range(0, len(hashes), _CHUNK):
        high = min(low + _CHUNK, len(hashes))
        bits = np.unpackbits(
            hashes[low:high].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        a = int(np.searchsorted(first, low, "right")) - 1
        b = int(np.searchsorted(first, high, "left"))
        starts = np.maximum(first[a:b], low) - low
        kept = np.concatenate([starts[:-1] < starts[1:], [True]])
        sums = np.add.reduceat(bits, starts[kept], axis=0, dtype=np.int32)
        counts[np.arange(a, b)[kept]] += sums
    over = counts * 2 > np.diff(first)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def _fingerprint_piece(texts, size: int) -> np.ndarray:
    found = words(texts)
    data, start, end = joined(texts, found)
    n_words = np.diff(found.first)
    n_shingles = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    first = np.concatenate([[0], np.cumsum(n_shingles)])
    at = np.arange(first[-1]) + np.repeat(found.first[:-1] - first[:-1], n_shingles)
    last = np.minimum(at + size, np.repeat(found.first[1:], n_shingles)) - 1
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[a:b], SEED) for a, b in zip(start[at].tolist(), end[last].tolist())), np.uint64, len(at)
    )
    return _bit_majority(hashes, first)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """A 64-bit SimHash per row: columns ``doc_id`` and ``fp`` (its bits as bigint).

    Texts are lower-cased (A-Z); shingles of ``size`` words, repeats included, are hashed
    with XXH64. Fewer words form one shingle; null, empty and blank texts get 0. Rows are
    kept as they are: repeated and null ids stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for texts in pieces(batch.column(1)):
                fp = _fingerprint_piece(texts, size).view(np.int64)
                own = ids.slice(texts.rows.start, len(texts))
                yield pa.record_batch([own, pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


# -- anchors -----------------------------------------------------------------------------
#
# A half of a fingerprint is one free bit and 31 bits of the Hamming code of length 31.
# Its code words are the anchors: every 32-bit value lies within 1 bit of one of them, so
# the covering radius is 1. Two fingerprints at most 3 bits apart agree up to 1 bit in one
# half. There the one's home anchor is within 1 + 1 bits of the other.

_POSITIONS = np.arange(1, 32, dtype=np.uint64)


def _syndrome(value: np.ndarray) -> np.ndarray:
    """XOR of the positions (1-31) of the set bits; bit p stands for position p."""
    out = np.zeros(len(value), np.uint64)
    for p in _POSITIONS:
        out ^= ((value >> p) & np.uint64(1)) * p
    return out


def anchor_rows(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor key, fingerprint and whether the anchor is its home, for all anchors within 2 bits."""
    one = np.uint64(1)
    keys, values, homes = [], [], []
    for half in (0, 1):
        value = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        mark = np.uint64(half << 32)
        syndrome = _syndrome(value)
        home = np.where(syndrome > 0, value ^ (one << syndrome), value)
        for key, is_home in ((home, True), (home ^ one, False)):
            keys.append(key | mark)
            values.append(fp)
            homes.append(np.full(len(fp), is_home))
        for p in _POSITIONS:
            other = syndrome ^ p
            use = (syndrome > 0) & (other > p)
            keys.append((value[use] ^ (one << p) ^ (one << other[use])) | mark)
            values.append(fp[use])
            homes.append(np.zeros(int(use.sum()), bool))
    return np.concatenate(keys), np.concatenate(values), np.concatenate(homes)


def _links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that share an anchor (rows sorted by key), reduced to stars."""
    low = np.searchsorted(key, key[home], "left")
    high = np.searchsorted(key, key[home], "right")
    mine = fp[home]
    found_a, found_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    size = high - low
    useful = np.flatnonzero(size > 1)
    mine, low, size = mine[useful], low[useful], size[useful]
    bound = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(mine):
        stop = max(at + 1, int(np.searchsorted(bound, bound[at] + (1 << 20), "right")) - 1)
        reps = size[at:stop]
        total = int(reps.sum())
        index = np.arange(total) + np.repeat(low[at:stop] - (bound[at:stop] - bound[at]), reps)
        a, b = np.repeat(mine[at:stop], reps), fp[index]
        near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        a, b = stars(a[near], b[near])
        found_a.append(a)
        found_b.append(b)
        at = stop
    return stars(np.concatenate(found_a), np.concatenate(found_b))


def link_fingerprints(fps: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) at most ``distance`` (up to 3) bits apart.

    Each anchor group is compared where it lies and leaves as stars, as many rows as
    fingerprints at most; linked fingerprints stay connected, though not every pair is
    returned. A group holds distinct fingerprints only, so copies do not make it larger.
    """
    if not 0 <= distance <= 3:
        raise ValueError("anchors cover distances of 0 to 3 bits")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, home = anchor_rows(batch.column(0).to_numpy().view(np.uint64))
            yield pa.record_batch(
                [pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"]
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, home = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)

        def out(last: int) -> pa.RecordBatch:
            a, b = _links(key[:last], fp[:last], home[:last], distance)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            more = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            key = np.concatenate([key, more[0].view(np.uint64)])
            fp = np.concatenate([fp, more[1].view(np.uint64)])
            home = np.concatenate([home, more[2]])
            last = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            if last:
                yield out(last)
                key, fp, home = key[last:], fp[last:], home[last:]
        if len(key):
            yield out(len(key))

    rows = fps.select("fp").mapInArrow(replicate, "anchor bigint, fp bigint, home boolean")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE) -> DataFrame:
    """Component of near-equal texts per row: ``doc_id``, ``fingerprint``, ``component_id``.

    ``component_id`` is the smallest id reachable over links. Rows without words have the
    fingerprint zero and are linked like others. Rows with null ids belong to components
    without naming them; a component of such rows only has a null id. An empty table gives
    no rows.
    """
    own = materialize(fingerprints(docs, id_col, text_col))
    unique = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = connected_components(link_fingerprints(unique, distance))
    placed = materialize(
        unique.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "doc_id", F.coalesce("root", "fp").alias("root")
        )
    )
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = placed.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return own.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE) -> DataFrame:
    """The documents of smallest id in their component, all columns as they came.

    Rows that repeat such an id stay together; rows with null ids stay, as nothing names them.
    """
    classes = near_duplicates(docs, id_col, text_col, distance)
    name = "_lost"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    lost = classes.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(name)).distinct()
    # Written first, so that Spark knows its size and can leave the texts where they are.
    return docs.join(materialize(lost), F.col(f"`{id_col}`") == F.col(name), "left_anti")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` at 3 or fewer differing bits."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
