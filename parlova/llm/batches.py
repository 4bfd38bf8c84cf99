"""Documents packed into stored batches, and keys that occur in more than one document.

A batch is a row with the bytes of many texts. Batches lie in a table bucketed by batch number,
so that small tables of results come to the texts and the texts themselves stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlova.llm.arrays import pieces
from parlova.runtime import materialize, scratch_path, scratch_scope

BATCH_BYTES = 2 << 20
BUCKETS_PER_PARTITION = 4
# Stands for a null id: larger than all.
NO_ID = np.iinfo(np.int64).max

# A function of a batch: the 64-bit keys of its documents, and the documents' numbers.
KeysOf = Callable[[dict], tuple[np.ndarray, np.ndarray]]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits spread over the whole of 64-bit numbers."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[: max(0, len(values) - size)], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: max(0, len(values) - rest)], values[rest:]) if rest else values


def packed_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The batches of a record batch, one at a time, their arrays unpacked."""
    for i in range(batch.num_rows):
        row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
        row["ids"] = np.frombuffer(row["ids"], "<i8")
        row["offsets"] = np.frombuffer(row["offsets"], "<i8")
        row["data"] = np.frombuffer(row["data"], np.uint8)
        yield row


@contextmanager
def packed_table(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int = BATCH_BYTES) -> Iterator[DataFrame]:
    """The table ``batch, ids, offsets, data`` of all rows, below the shared folder.

    It goes when the block ends, and so does what is materialised inside the block; write results
    elsewhere before.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            for texts in pieces(batch.column(1), batch_bytes):
                values = (ids[texts.rows].astype("<i8"), texts.offsets.astype("<i8"), texts.data)
                yield pa.record_batch(
                    [pa.array([number], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in values)],
                    names=["batch", "ids", "offsets", "data"],
                )
                number += 1

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    name = f"packed_{uuid.uuid4().hex}"
    with scratch_scope(spark):
        (
            rows.mapInArrow(pack, "batch bigint, ids binary, offsets binary, data binary")
            .repartition(partitions, "batch")
            .write.bucketBy(partitions, "batch")
            .option("compression", "zstd")
            .option("path", scratch_path(spark, "packed"))
            .format("parquet")
            .saveAsTable(name)
        )
        try:
            yield spark.table(name)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


# -- keys: five bytes each, besides the number of their bucket ---------------------------------


def _pack40(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack40(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    out = np.zeros((len(flat), 8), np.uint8)
    out[:, :5] = flat
    return out.view("<u8").ravel()


def _bucket(key: np.ndarray, n_buckets: int) -> np.ndarray:
    return (key & np.uint64(0xFFFFFF)) % np.uint64(n_buckets)


def _keys_by_bucket(key: np.ndarray, doc: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, distinct keys, numbers of documents of keys of several) of a batch."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])[: len(key)]
    key, count = np.unique(key[once], return_counts=True)
    bucket = _bucket(key, n_buckets)
    order = np.argsort(bucket, kind="stable")
    key, count, bucket = key[order] >> np.uint64(24), count[order], bucket[order].astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
    for a, b in zip(edges[:-1], edges[1:]):
        more = np.flatnonzero(count[a:b] > 1)
        yield int(bucket[a]), _pack40(key[a:b]), np.stack([more, count[a:b][more]]).astype("<u4").tobytes()


def _shared_of(table: pa.Table, hot_docs: int) -> pa.Table:
    """The keys of a bucket that occur in two documents, by batch; and which are hot."""
    keys = [_unpack40(k) for k in table["keys"].to_pylist()]
    counts = []
    for own, more in zip(keys, table["more"].to_pylist()):
        c = np.ones(len(own), np.int64)
        index, number = np.frombuffer(more, "<u4").reshape(2, -1)
        c[index] = number
        counts.append(c)
    _, index = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(index, weights=np.concatenate(counts)).astype(np.int64)[index]
    at, rows = 0, []
    for batch, own in zip(table["batch"].to_pylist(), keys):
        here = total[at : at + len(own)]
        at += len(own)
        use = here > 1
        if use.any():
            rows.append((batch, _pack40(own[use]), np.packbits(here[use] > hot_docs).tobytes()))
    return pa.table(
        {
            "batch": pa.array([r[0] for r in rows], pa.int64()),
            "bucket": pa.array([table["bucket"][0].as_py()] * len(rows), pa.int64()),
            "keys": pa.array([r[1] for r in rows], pa.binary()),
            "hot": pa.array([r[2] for r in rows], pa.binary()),
        }
    )


@dataclass(frozen=True)
class SharedKeys:
    """Batches with their shared keys in the column ``shared``; the number of buckets decodes it."""

    rows: DataFrame
    n_buckets: int


def with_shared_keys(texts: DataFrame, keys_of: KeysOf, hot_docs: int) -> SharedKeys:
    """Which keys of each batch occur in two documents or more, anywhere.

    Keys are cut to 40 bits and their bucket's number, so a few lone ones may pass. A batch
    names a key once, however many of its documents have it; a bucket is a small part of all keys.
    """
    n_buckets = BUCKETS_PER_PARTITION * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in packed_rows(batch):
                found = list(_keys_by_bucket(*keys_of(row), n_buckets))
                yield pa.record_batch(
                    [
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([row["batch"]] * len(found), pa.int64()),
                        pa.array([f[1] for f in found], pa.binary()),
                        pa.array([f[2] for f in found], pa.binary()),
                    ],
                    names=["bucket", "batch", "keys", "more"],
                )

    def shared_of(table: pa.Table) -> pa.Table:
        return _shared_of(table, hot_docs)

    keys = texts.mapInArrow(send, "bucket bigint, batch bigint, keys binary, more binary")
    shared = materialize(keys.groupBy("bucket").applyInArrow(shared_of, "batch bigint, bucket bigint, keys binary, hot binary"))
    shared = shared.groupBy("batch").agg(F.collect_list(F.struct("bucket", "keys", "hot")).alias("shared"))
    return SharedKeys(texts.join(shared, "batch", "left"), n_buckets)


def shared_in(row: dict, key: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys are shared, and which are hot, by the row's ``shared``."""
    known, hot = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for part in row["shared"] or ():
        keys = _unpack40(part["keys"])
        known.append(keys | np.uint64(part["bucket"] << 40))
        hot.append(np.unpackbits(np.frombuffer(part["hot"], np.uint8))[: len(keys)].astype(bool))
    known_keys, known_hot = np.concatenate(known), np.concatenate(hot)
    if not len(known_keys):
        return np.zeros(len(key), bool), np.zeros(len(key), bool)
    order = np.argsort(known_keys)
    known_keys, known_hot = known_keys[order], known_hot[order]
    own = (key >> np.uint64(24)) | (_bucket(key, n_buckets) << np.uint64(40))
    at = np.minimum(np.searchsorted(known_keys, own), len(known_keys) - 1)
    use = known_keys[at] == own
    return use, use & known_hot[at]


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of each shard that occurs."""
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(shard[order].astype(np.int64)) != 0, [True]]))
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield int(shard[order[a]]), order[a:b]
