"""k-means from many starts at once: each round is one scan for all starts.

Vectors are a ``features`` vector column (sparse or dense), or ``vec`` arrays. The driver
and each task hold the centres of all starts: starts x clusters x dimensions numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlova.runtime import materialize

# Values of one step inside a task: each meets all centres at once.
STEP_VALUES = 1 << 15
_COUNT, _COST = -1, -2


def cluster_count(n_texts: int, wanted: int = 8) -> int:
    return min(wanted, max(2, n_texts // 5))


@dataclass(frozen=True)
class KMeansFit:
    centers: np.ndarray  # clusters x dimensions
    cost: float
    seed: int
    costs: tuple[float, ...] = ()  # of every start
    rounds: int = 0


@dataclass(frozen=True)
class _Rows:
    """Vectors side by side: row i has the values from ``start[i]`` up to ``start[i + 1]``."""

    start: np.ndarray
    idx: np.ndarray | None  # None: dense
    val: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def steps(self) -> Iterator[tuple[int, int, _Rows]]:
        low = 0
        while low < len(self):
            room = int(np.searchsorted(self.start, self.start[low] + STEP_VALUES, "right")) - 1
            high = min(len(self), max(low + 1, room))
            a, b = self.start[low], self.start[high]
            idx = None if self.idx is None else self.idx[a:b]
            yield low, high, _Rows(self.start[low : high + 1] - a, idx, self.val[a:b])
            low = high

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def squared_distances(self, centers: np.ndarray) -> np.ndarray:
        """Rows x centres."""
        n = len(self)
        if self.idx is None:
            x = self.val.reshape(n, centers.shape[1])
            cross, own = x @ centers.T, (x * x).sum(1)
        else:
            cross = np.zeros((n, len(centers)))
            filled = np.flatnonzero(np.diff(self.start))
            if len(filled):
                shared = centers.T[self.idx] * self.val[:, None]
                cross[filled] = np.add.reduceat(shared, self.start[filled], axis=0)
            own = np.bincount(self.owner(), self.val * self.val, n)
        return np.maximum(own[:, None] - 2.0 * cross + (centers * centers).sum(1)[None, :], 0.0)

    def sums(self, label: np.ndarray, k: int, dims: int) -> np.ndarray:
        """Sum of the rows of each label."""
        if self.idx is None:
            return np.eye(k)[label].T @ self.val.reshape(len(self), dims)
        return np.bincount(label[self.owner()] * dims + self.idx, self.val, k * dims).reshape(k, dims)


def _raw(vectors: DataFrame) -> Column:
    """Struct of size, indices (null: dense) and values."""
    if "features" in vectors.columns:
        raw = F.unwrap_udt("features")
        size, indices, values = F.coalesce(raw["size"], F.size(raw["values"])), raw["indices"], raw["values"]
    else:
        values = F.col("vec").cast("array<double>")
        size, indices = F.size(values), F.lit(None).cast("array<int>")
    return F.struct(size.alias("size"), indices.alias("indices"), values.alias("values"))


def _rows_of(idx: pa.Array, val: pa.Array) -> _Rows:
    start = np.concatenate([[0], np.cumsum(val.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = val.flatten().to_numpy(zero_copy_only=False)
    if idx.null_count == len(idx):
        return _Rows(start, None, flat)
    if idx.null_count:
        places = [np.arange(len(v)) if i is None else np.asarray(i) for i, v in zip(idx.to_pylist(), val.to_pylist())]
        return _Rows(start, np.concatenate(places).astype(np.int64), flat)
    return _Rows(start, idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64), flat)


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) from a row's hash and a salt."""
    h = key.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _draw(data: DataFrame, centers: np.ndarray | None, salts: list[int]) -> list[np.ndarray | None]:
    """One row per start, drawn in proportion to its squared distance from the start's centres.

    Each row has an exponential clock of that rate, driven by its hash; the first to ring
    wins. A task sends one row per start.
    """

    def ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            rows = _rows_of(batch.column(1), batch.column(2))
            key = batch.column(0).to_numpy()
            for low, high, part in rows.steps():
                for s, salt in enumerate(salts):
                    rate = np.ones(high - low) if centers is None else part.squared_distances(centers[s]).min(1)
                    with np.errstate(divide="ignore"):
                        clock = -np.log(_uniform(key[low:high], salt)) / rate
                    at = int(np.lexsort((key[low:high], clock))[0])
                    found = (float(clock[at]), int(key[low + at]))
                    if s not in best or found < best[s][:2]:
                        best[s] = (*found, batch.column(1)[low + at].as_py(), batch.column(2)[low + at].as_py())
        if best:
            columns = [pa.array(sorted(best), pa.int32())]
            for i, kind in enumerate([pa.float64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64())]):
                columns.append(pa.array([best[s][i] for s in sorted(best)], kind))
            yield pa.RecordBatch.from_arrays(columns, names=["start", "clock", "key", "idx", "val"])

    rang = data.select("key", "idx", "val").mapInArrow(
        ring, "start int, clock double, key bigint, idx array<int>, val array<double>"
    )
    first = rang.groupBy("start").agg(F.min(F.struct("clock", "key", "idx", "val")).alias("w")).select("start", "w.*")
    out: list[np.ndarray | None] = [None] * len(salts)
    dims = None if centers is None else centers.shape[2]
    for row in first.collect():
        size = dims or data.select(F.max("size")).first()[0]
        vector = np.zeros(size)
        vector[np.arange(len(row.val)) if row.idx is None else row.idx] = row.val
        dims, out[row.start] = size, vector
    return out


def _round(data: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, counts and costs of the rows nearest to each centre of each start, in one scan."""
    starts, k, dims = centers.shape
    flat_centers = centers.reshape(starts * k, dims)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, cost = np.zeros((starts, k, dims)), np.zeros((starts, k)), np.zeros((starts, k))
        for batch in batches:
            for _, _, part in _rows_of(batch.column(0), batch.column(1)).steps():
                squared = part.squared_distances(flat_centers).reshape(len(part), starts, k)
                nearest = squared.argmin(2)
                least = squared.min(2)
                for s in range(starts):
                    total[s] += part.sums(nearest[:, s], k, dims)
                    count[s] += np.bincount(nearest[:, s], minlength=k)
                    cost[s] += np.bincount(nearest[:, s], least[:, s], k)
        total, count, cost = total.reshape(-1, dims), count.ravel(), cost.ravel()
        cell, pos = np.nonzero(total)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([cell, used, used]).astype(np.int32)),
                pa.array(np.concatenate([pos, np.full(len(used), _COUNT), np.full(len(used), _COST)]).astype(np.int32)),
                pa.array(np.concatenate([total[cell, pos], count[used], cost[used]])),
            ],
            names=["cell", "pos", "x"],
        )

    parts = data.select("idx", "val").mapInArrow(assign, "cell int, pos int, x double")
    summed = parts.groupBy("cell", "pos").agg(F.sum("x").alias("x")).toArrow()
    cell, pos, x = (summed.column(i).to_numpy() for i in range(3))
    # Counts and costs lie behind the dimensions: positions -1 and -2 from the end.
    wide = np.zeros((starts * k, dims + 2))
    wide[cell, pos] = x
    wide = wide.reshape(starts, k, dims + 2)
    return wide[..., :dims], wide[..., _COUNT], wide[..., _COST].sum(1)


def fit_kmeans(
    vectors: DataFrame, wanted: int = 8, n_init: int = 10, seed: int = 42, max_rounds: int = 20, tolerance: float = 1e-4
) -> KMeansFit:
    """Best of ``n_init`` starts by cost (sum of squared distances; ties to the earlier start).

    Starts are drawn by squared distance (k-means++), a scan per centre, and move together, a
    scan per round, until no centre of a start moves by more than ``tolerance``. A start that
    rests is left out of later rounds. A centre without rows stays where it is. Draws follow a
    hash of ``vec_id``, else of the vector, so reruns draw alike. Null vectors take no part; a
    table without vectors is an error.
    """
    raw = _raw(vectors)
    key = F.xxhash64("vec_id") if "vec_id" in vectors.columns else F.xxhash64(raw["indices"], raw["values"])
    data = materialize(
        vectors.select(
            key.alias("key"), raw["indices"].alias("idx"), raw["values"].alias("val"),
            raw["size"].alias("size"),
        ).where(F.col("val").isNotNull())
    )
    n_rows = data.count()
    if not n_rows:
        raise ValueError("k-means needs at least one vector")
    k = cluster_count(n_rows, wanted)
    centers: np.ndarray | None = None
    for step in range(k):
        drawn = np.stack(_draw(data, centers, [(seed + s) * 1_000_003 + step for s in range(n_init)]))[:, None, :]
        centers = drawn if centers is None else np.concatenate([centers, drawn], axis=1)
    moving, rounds = np.arange(n_init), 0
    while len(moving) and rounds < max_rounds:
        total, count, _ = _round(data, centers[moving])
        means = np.where(count[..., None] > 0, total / np.maximum(count, 1)[..., None], centers[moving])
        shift = ((means - centers[moving]) ** 2).sum(2).max(1)
        centers[moving] = means
        moving, rounds = moving[shift > tolerance**2], rounds + 1
    costs = _round(data, centers)[2]
    best = int(np.argmin(costs))
    return KMeansFit(centers[best], float(costs[best]), seed + best, tuple(map(float, costs)), rounds)


def assign_kmeans(vectors: DataFrame, fit: KMeansFit) -> DataFrame:
    """Add ``cluster``: the nearest centre, the smaller number on ties; null for a null vector."""
    centers = fit.centers

    @F.pandas_udf("int")
    def nearest(raw: pd.DataFrame) -> pd.Series:
        known = raw["values"].notna().to_numpy()
        label = np.full(len(raw), -1)
        if known.any():
            idx = pa.array(raw["indices"][known].tolist(), pa.list_(pa.int32()))
            rows = _rows_of(idx, pa.array(raw["values"][known].tolist(), pa.list_(pa.float64())))
            label[known] = np.concatenate([part.squared_distances(centers).argmin(1) for _, _, part in rows.steps()])
        return pd.Series(label).where(pd.Series(known)).astype("Int32")

    return vectors.withColumn("cluster", nearest(_raw(vectors)))
