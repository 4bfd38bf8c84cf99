"""Exact removal of repeated byte strings across documents, by suffix arrays of shards.

A 50-byte window is found where an equal one starts in a document with a smaller id:

1. Documents are packed into batches, kept as a table bucketed by batch.
2. Each window has an anchor, its 24-byte string of least hash. Equal windows have equal anchors, so
   only anchors that occur in two documents matter; batches send their anchors' keys, a
   bucket of keys tells which are shared.
3. Windows with the same shared anchor make a segment of 50 to 76 bytes. Segments go to shards by
   anchor. A shard sorts all suffixes of its distinct segments by induced sorting; equal
   windows are runs in which the permuted common prefix is 50 or more, and the smallest
   document of a run owns it.
4. The answers, one bit per window, return to their batches, where the bytes are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlova.llm.arrays import codes
from parlova.llm.batches import (
    BATCH_BYTES,
    BUCKETS_PER_PARTITION,
    NO_ID,
    by_shard,
    mixed,
    packed_rows,
    packed_table,
    shared_in,
    sliding_min,
    with_shared_keys,
)
from parlova.llm.induced import byte_lcp, induced_suffix_array
from parlova.runtime import materialize, scratch_path

WINDOW = 50
ANCHOR = 24
# Anchors of more documents than this send each window to a shard of its own hash.
HOT_DOCS = 1000
# Windows hashed at a time, so that the arrays of a step stay in a core's cache.
STEP = 1 << 15
# A shard's segments lie in so many parts by anchor; parts are sorted together up to these bytes.
PARTS = 64
PART_BYTES = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTE_HASH = np.random.default_rng(50).integers(0, 2**64, 256, np.uint64, endpoint=False)


# -- anchors ----------------------------------------------------------------------------------


def rolling_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every string of ``length`` bytes, by doubling."""
    h, size, base = _BYTE_HASH[data], 1, _MIX
    out, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                if out is None:
                    out = h
                else:
                    n = len(data) - done - size + 1
                    out = out[:n] * base
                    out += h[done : done + n]
                done += size
                if done == length:
                    return mixed(out)
            ahead = h[size:]
            h = h[: len(ahead)] * base
            h += ahead
            size, base = size * 2, base * base


@dataclass(frozen=True)
class Anchored:
    """The segments of a batch: windows ``first[i]`` to ``last[i]`` of document ``doc[i]`` share an anchor."""

    key: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray


def anchored(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> Anchored:
    n = len(data) - window + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return Anchored(none.view(np.uint64), none, none, none)
    # Segments end with their document and before windows that reach into the next one.
    cut = np.concatenate([offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - window + 1)])
    cut = np.unique(cut[cut < n])
    low = np.uint64(0xFFFFFFFF)
    places, keys, before = [], [], None
    for a in range(0, n, STEP):
        b = min(n, a + STEP)
        h = rolling_hashes(data[a : b + window - 1], anchor)
        packed = h & ~low
        packed |= np.arange(a, a + len(h), dtype=np.uint64)
        least = sliding_min(packed, window - anchor + 1)
        new = np.empty(b - a, bool)
        new[0] = before is None or least[0] != before
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[cut[np.searchsorted(cut, a) : np.searchsorted(cut, b)] - a] = True
        at = np.flatnonzero(new)
        places.append(at + a)
        keys.append(h[(least[at] & low).astype(np.int64) - a])
        before = least[-1]
    first = np.concatenate(places)
    last = np.append(first[1:], n) - 1
    doc = np.searchsorted(offsets, first, "right") - 1
    whole = first + window <= offsets[doc + 1]
    return Anchored(np.concatenate(keys)[whole], first[whole], last[whole], doc[whole])


# -- step 3: segments and shards --------------------------------------------------------------


@dataclass(frozen=True)
class Segments:
    """Segments with shared anchors; equal ones of a batch have the same ``group``."""

    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    route: np.ndarray
    group: np.ndarray
    n_groups: int


def batch_segments(row: dict, n_buckets: int, window: int, anchor: int) -> Segments:
    """The same segments in the same order whenever they are made from the same row."""
    found = anchored(row["data"], row["offsets"], window, anchor)
    use, hot = shared_in(row, found.key, n_buckets)
    first, last, doc, route, is_hot = found.first[use], found.last[use], found.doc[use], found.key[use], hot[use]
    if is_hot.any():
        # One segment per window, routed by the hash of the window.
        count = np.where(is_hot, last - first + 1, 1)
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        split = np.repeat(is_hot, count)
        first = np.repeat(first, count) + np.where(split, step, 0)
        last = np.where(split, first, np.repeat(last, count))
        doc, route = np.repeat(doc, count), np.repeat(route, count)
        route[split] = rolling_hashes(row["data"], window)[first[split]]
    group = codes(row["data"], first, last + window)
    # The same string under a hot and a plain anchor stays in one group: its route follows its anchor.
    return Segments(first, last, doc, route, group, int(group.max()) + 1 if len(group) else 0)


def _group_docs(found: Segments, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per group its smallest document id, and one of its segments."""
    least = np.full(found.n_groups, NO_ID, np.int64)
    np.minimum.at(least, found.group, ids[found.doc])
    one = np.zeros(found.n_groups, np.int64)
    one[found.group] = np.arange(len(found.group))
    return least, one


def _batch_shards(row: dict, n_shards: int, n_buckets: int, window: int, anchor: int) -> Iterator[tuple]:
    """(shard, groups, smallest ids, lengths, bytes, groups in each part) of a batch, in the order of parts."""
    found = batch_segments(row, n_buckets, window, anchor)
    if not found.n_groups:
        return
    least, one = _group_docs(found, row["ids"])
    first, length = found.first[one], found.last[one] + window - found.first[one]
    route = found.route[one]
    part = (route % np.uint64(PARTS)).astype(np.uint8)
    for shard, at in by_shard((route >> np.uint64(8)) % np.uint64(n_shards)):
        at = at[np.argsort(part[at], kind="stable")]
        n = length[at]
        index = np.arange(int(n.sum())) + np.repeat(first[at] - (np.cumsum(n) - n), n)
        yield (
            shard, at.astype("<i4").tobytes(), least[at].astype("<i8").tobytes(),
            n.astype("<i4").tobytes(), row["data"][index].tobytes(),
            np.bincount(part[at], minlength=PARTS).astype("<i4").tobytes(),
        )


def owners(data: np.ndarray, bounds: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """For each place of strings ``data[bounds[i]:bounds[i + 1]]``, the smallest id with its window.

    Places within ``window`` of their string's end start none and get the largest number.
    """
    size = np.diff(bounds)
    gaps = bounds[:-1] + np.arange(len(size))
    total = int(bounds[-1]) + len(size)
    values, raw = np.zeros(total, np.uint16), np.zeros(total, np.uint8)
    place = np.arange(int(bounds[-1])) + np.repeat(np.arange(len(size)), size)
    values[place], raw[place] = data.astype(np.uint16) + 1, data
    string = np.repeat(np.arange(len(size)), size + 1)
    end = (gaps + size)[string]
    order = induced_suffix_array(values, 257)
    lcp = byte_lcp(raw, end, order, window)
    starts = end - np.arange(total) >= window
    own = np.where(starts, least[string], NO_ID)[order]
    run = np.flatnonzero(lcp[order] < window)
    best = np.minimum.reduceat(own, run) if len(run) else own
    out = np.empty(total, np.int64)
    out[order] = np.repeat(best, np.diff(np.append(run, total)))
    out[~starts] = NO_ID
    return out[place]


def _smaller_owners(ids: np.ndarray, n: np.ndarray, data: np.ndarray, window: int) -> np.ndarray:
    """Per string of length ``n``, a bit for each window that a document smaller than ``ids`` owns."""
    bounds = np.concatenate([[0], np.cumsum(n)])
    # Equal strings of several batches enter the array once, with their smallest id.
    code = codes(data, bounds[:-1], bounds[1:])
    count = int(code.max()) + 1
    least, one = np.full(count, NO_ID, np.int64), np.zeros(count, np.int64)
    np.minimum.at(least, code, ids)
    one[code] = np.arange(len(code))
    size = n[one]
    own = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(int(own[-1])) + np.repeat(bounds[one] - own[:-1], size)
    owner = owners(data[index], own, least, window)
    windows = size - window + 1
    mask = np.zeros(len(code), np.uint64)
    for j in range(int(windows.max())):
        at = np.flatnonzero(windows[code] > j)
        smaller = owner[own[code[at]] + j] < ids[at]
        mask[at] |= smaller.astype(np.uint64) << np.uint64(j)
    return mask


def _answers_of(table: pa.Table, window: int, part_bytes: int = PART_BYTES) -> pa.Table:
    """Which windows of each group are owned by a smaller document than the group's: a bit each.

    Equal windows have one anchor and so lie in one part; parts are sorted by themselves, a few
    together up to ``part_bytes``, which keeps the arrays of a large shard small.
    """
    groups, ids, sizes, data, parts = (
        [np.frombuffer(x, kind) for x in table[name].to_pylist()]
        for name, kind in (("groups", "<i4"), ("least", "<i8"), ("sizes", "<i4"), ("data", np.uint8), ("parts", "<i4"))
    )
    bound = [np.concatenate([[0], np.cumsum(p)]) for p in parts]
    byte = [np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[b] for n, b in zip(sizes, bound)]
    total = np.sum(byte, axis=0)
    masks = [np.zeros(len(g), np.uint64) for g in groups]
    low = 0
    while low < PARTS:
        high = max(low + 1, int(np.searchsorted(total, total[low] + part_bytes, "right")) - 1)
        if total[high] > total[low]:
            mask = _smaller_owners(
                np.concatenate([x[b[low] : b[high]] for x, b in zip(ids, bound)]),
                np.concatenate([x[b[low] : b[high]] for x, b in zip(sizes, bound)]).astype(np.int64),
                np.concatenate([x[b[low] : b[high]] for x, b in zip(data, byte)]),
                window,
            )
            at = 0
            for own, b in zip(masks, bound):
                n = b[high] - b[low]
                own[b[low] : b[high]] = mask[at : at + n]
                at += n
        low = high
    rows = []
    for batch, group, own in zip(table["batch"].to_pylist(), groups, masks):
        use = own > 0
        if use.any():
            rows.append((batch, group[use].astype("<i4").tobytes(), own[use].astype("<u8").tobytes()))
    return pa.table(
        {
            "batch": pa.array([r[0] for r in rows], pa.int64()),
            "groups": pa.array([r[1] for r in rows], pa.binary()),
            "masks": pa.array([r[2] for r in rows], pa.binary()),
        }
    )


# -- step 4: removal --------------------------------------------------------------------------


def _removed(row: dict, n_buckets: int, window: int, anchor: int) -> np.ndarray:
    """Which bytes of a batch go."""
    n = len(row["data"])
    found = batch_segments(row, n_buckets, window, anchor)
    change = np.zeros(n + 1, np.int64)
    if found.n_groups:
        least, _ = _group_docs(found, row["ids"])
        mask = np.zeros(found.n_groups, np.uint64)
        for part in row["answers"] or ():
            mask[np.frombuffer(part["groups"], "<i4")] |= np.frombuffer(part["masks"], "<u8")
        own = mask[found.group]
        # A later copy inside the batch loses every window to the group's smallest document.
        own[row["ids"][found.doc] > least[found.group]] = np.uint64(2**64 - 1)
        for j in range(int((found.last - found.first).max()) + 1):
            at = found.first[(found.last - found.first >= j) & ((own >> np.uint64(j)) & np.uint64(1) > 0)] + j
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
    return np.cumsum(change[:-1]) > 0


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _results(row: dict, gone: np.ndarray, keep_bytes: bool) -> pa.RecordBatch:
    offsets, data = row["offsets"], row["data"]
    total = np.concatenate([[0], np.cumsum(gone)])
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    begin[starts] = gone[starts]
    spans = np.concatenate([[0], np.cumsum(begin)])
    kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
    columns = [
        pa.array([None if i == NO_ID else i for i in row["ids"].tolist()], pa.int64()),
        pa.array(np.diff(offsets)),
        pa.array(total[offsets[1:]] - total[offsets[:-1]]),
        pa.array(spans[offsets[1:]] - spans[offsets[:-1]]),
        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
    ]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if keep_bytes:
        columns.append(pa.array(kept, pa.binary()))
        names.append("kept")
    return pa.record_batch(columns, names=names)


# -- Spark ------------------------------------------------------------------------------------


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    batch_bytes: int = BATCH_BYTES,
    hot_docs: int = HOT_DOCS,
    keep_bytes: bool = False,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes left) per row.

    Removed is each byte covered by a ``window``-byte string of the UTF-8 text that also starts
    in a row with a smaller id. Null texts are empty; texts shorter than the window lose
    nothing. Rows with equal ids do not take from each other; a null id counts as larger than
    all, and such rows do not take from each other either. ``window - anchor`` is at most 63.

    Memory follows a batch, a text, or the keys and segments of one bucket or shard, whose
    number grows with ``spark.sql.shuffle.partitions``. Repeats inside a batch and copies between
    batches are merged before they are sorted; an anchor of more than ``hot_docs`` documents is
    split by window. Intermediate tables are removed at the end; the result is a written table.
    """
    if not 8 <= anchor <= window or window - anchor > 63:
        raise ValueError("the anchor must fit the window with at most 63 places to spare")
    n_shards = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def anchors_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        found = anchored(row["data"], row["offsets"], window, anchor)
        return found.key, found.doc

    spark = docs.sparkSession
    path = scratch_path(spark, "kept")
    with packed_table(docs, id_col, text_col, batch_bytes) as texts:
        shared = with_shared_keys(texts, anchors_of, hot_docs)
        n_buckets = shared.n_buckets

        def send_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in packed_rows(batch):
                    found = list(_batch_shards(row, n_shards, n_buckets, window, anchor))
                    yield pa.record_batch(
                        [
                            pa.array([f[0] for f in found], pa.int64()),
                            pa.array([row["batch"]] * len(found), pa.int64()),
                            *(pa.array([f[i] for f in found], pa.binary()) for i in range(1, 6)),
                        ],
                        names=["shard", "batch", "groups", "least", "sizes", "data", "parts"],
                    )

        def answers_of(table: pa.Table) -> pa.Table:
            return _answers_of(table, window)

        def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in packed_rows(batch):
                    yield _results(row, _removed(row, n_buckets, window, anchor), keep_bytes)

        segments = shared.rows.mapInArrow(
            send_segments, "shard bigint, batch bigint, groups binary, least binary, sizes binary, data binary, parts binary"
        )
        answers = materialize(segments.groupBy("shard").applyInArrow(answers_of, "batch bigint, groups binary, masks binary"))
        answers = answers.groupBy("batch").agg(F.collect_list(F.struct("groups", "masks")).alias("answers"))
        result = _RESULT + (", kept binary" if keep_bytes else "")
        shared.rows.join(answers, "batch", "left").mapInArrow(remove, result).write.parquet(path)
    return spark.read.schema(result).parquet(path)


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings of all ``documents``."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
