"""Exact top-k over dense vectors with cells that a bound can skip.

Documents lie in cells around pivots, each cell cut into rings by the angle to its pivot. For a query at angle t
to a pivot, no document of the ring [low, high] is nearer than the gap between t and the ring (triangle
inequality of angles), so the ring's best cosine is bounded. A query first visits the ring with the best
bound; the k-th score found there tells which other rings can still matter. Queries that need few other rings are
sent to them. Where bounds help little, as in data without structure, nearly every query needs nearly every
ring, which is what an exact result costs there: blocks of neighbouring queries are then joined with the rings, so that no
vector is sent more than once, and a task keeps the best rows of its queries while the rings pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlova.operators.frames import union_all
from parlova.operators.grid import (
    MAX_VALUES,
    Cell,
    best_of_rows,
    block_pairs,
    block_rows_of,
    cross_blocks,
    pack_blocks,
    unit_matrix,
    unit_rows,
)
from parlova.operators.ranking import hash_sample, top_k
from parlova.runtime import materialize, scratch_scope

# Rows of a ring, and of the queries that meet it in one task.
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 4_096
# Queries of a task where all documents lie in one ring.
SMALL_QUERIES = 1_024
# Bounds of what the driver and each task hold: pivots, angle bins of a cell, rings.
MAX_PIVOTS = 256
ANGLE_BINS = 256
MAX_BLOCKS = 65_536
# Rings that queries visit on the average, besides their best one, up to which they are sent there.
FEW_VISITS = 2
# Slack for rounding, in angles and cosines alike.
SLACK = 1e-7
# Query-ring numbers, and rows that visit rings, that a task holds at once.
_CHUNK = 1 << 20
_VISIT_ROWS = 1 << 13


@dataclass(frozen=True)
class Rings:
    """Unit pivots, and per ring its pivot (-1 for vectors of length 0) and least and greatest angle."""

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __len__(self) -> int:
        return len(self.pivot)

    def bounds(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest cosine, angle to the pivot) of each unit row and ring; cosines are 0 at least."""
        if not len(self.pivots):
            return np.zeros((len(unit), len(self))), np.zeros((len(unit), len(self)))
        angle = np.arccos(np.clip(unit @ self.pivots.T, -1.0, 1.0))[:, np.maximum(self.pivot, 0)]
        gap = np.maximum(self.low - angle, angle - self.high)
        best = np.cos(np.clip(gap, 0.0, math.pi))
        best[:, self.pivot < 0] = 0.0
        return np.clip(best, 0.0, 1.0), angle

    def reached(self, unit: np.ndarray, weight: float, most: np.ndarray, kth: np.ndarray | None, home: np.ndarray | None = None) -> np.ndarray:
        """Whether each unit row visits each ring: its ``home``, by default the best one; with ``kth`` the others that can reach it."""
        cosine, angle = self.bounds(unit)
        bound = weight * cosine + most[:, None]
        # Of equal bounds the nearer pivot.
        best = (bound - 1e-3 * angle).argmax(axis=1) if home is None else home
        use = np.zeros(bound.shape, bool) if kth is None else bound + SLACK >= kth[:, None]
        use[np.arange(len(unit)), best] = kth is None
        return use & (bound > 0)

    def only(self, ring: int) -> Rings:
        """One of the rings."""
        of = self.pivot[[ring]]
        return Rings(self.pivots[np.maximum(of, 0)], np.minimum(of, 0), self.low[[ring]], self.high[[ring]])


def _place(docs: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``_pivot`` (-1 without a direction), ``_angle`` and ``_bin`` to the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = unit_matrix(pa.chunked_array([batch["vec"]]))
            some = unit.any(axis=1)
            cosine = unit @ pivots.T if len(pivots) and some.any() else np.zeros((len(unit), 0))
            nearest = cosine.argmax(axis=1) if cosine.size else np.zeros(len(unit), int)
            best = cosine[np.arange(len(unit)), nearest] if cosine.size else np.zeros(len(unit))
            angle = np.where(some, np.arccos(np.clip(best, -1.0, 1.0)), 0.0)
            bins = np.minimum((angle * (ANGLE_BINS / math.pi)).astype(np.int32), ANGLE_BINS - 1)
            places = [np.where(some, nearest, -1).astype(np.int32), angle, bins]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(p) for p in places]], names=[*batch.schema.names, "_pivot", "_angle", "_bin"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, _pivot int, _angle double, _bin int")


def build_rings(docs: DataFrame, block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS) -> tuple[DataFrame, Rings]:
    """(documents with their ``block``, rings).

    Pivots are documents chosen by a hash, their number follows the rows up to ``max_pivots``. Neighbouring angle bins are
    joined to rings of at most ``block_rows`` rows (more where there would be over MAX_BLOCKS rings); a bin
    with more rows, copies of one vector say, is dealt to several rings of the same bounds.
    """
    n = docs.count()
    block_rows = max(block_rows, math.ceil(2 * n / MAX_BLOCKS))
    wanted = max(1, min(max_pivots, n // block_rows))
    chosen = hash_sample(docs.where(F.exists("vec", lambda x: x != 0)).select("doc_id", "vec"), "doc_id", wanted, 42)
    sample = chosen.select("vec").toPandas()["vec"]
    pivots = unit_rows(sample) if len(sample) else np.zeros((0, 1))
    pivots = pivots[np.isfinite(pivots).all(axis=1)]
    placed = materialize(_place(docs, pivots))
    stats = placed.groupBy("_pivot", "_bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("_angle").alias("low"), F.max("_angle").alias("high")
    )
    rings: list[tuple[int, float, float]] = []
    dealt, held = [], 0
    # At most MAX_PIVOTS * ANGLE_BINS rows.
    for row in sorted(stats.collect(), key=lambda r: (r["_pivot"], r["_bin"])):
        parts = math.ceil(row["n"] / block_rows)
        joins = rings and rings[-1][0] == row["_pivot"] and parts == 1 and held + row["n"] <= block_rows
        if joins:
            rings[-1] = (row["_pivot"], rings[-1][1], row["high"])
            held += row["n"]
        else:
            rings += [(row["_pivot"], row["low"], row["high"])] * parts
            held = row["n"] if parts == 1 else block_rows
        dealt.append((row["_pivot"], row["_bin"], len(rings) - parts, parts))
    table = docs.sparkSession.createDataFrame(dealt, "_pivot int, _bin int, _first int, _parts int")
    block = F.col("_first") + F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int")
    rows = placed.join(F.broadcast(table), ["_pivot", "_bin"]).withColumn("block", block).select(*docs.columns, "block")
    pivot, low, high = (np.array(c) for c in zip(*rings)) if rings else (np.zeros(0, int), np.zeros(0), np.zeros(0))
    return rows, Rings(pivots, pivot, low - SLACK, high + SLACK)


def visits(queries: DataFrame, rings: Rings, weight: float, first: bool) -> DataFrame:
    """One row per ring that a query visits: its best one (``_home``, if known), or the others that can reach its ``_kth`` score.

    ``_most`` is the most that anything but the weighted cosine can add to a score. Only positive scores count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = max(1, _CHUNK // max(1, len(rings)))
        for batch in batches:
            for low in range(0, len(batch), rows):
                own = batch.iloc[low : low + rows]
                unit = np.nan_to_num(unit_rows(own["vec"]))
                home = own["_home"].to_numpy() if "_home" in own else None
                use = rings.reached(unit, weight, own["_most"].to_numpy(), None if first else own["_kth"].to_numpy(), home)
                at, block = np.nonzero(use)
                # A query may visit every ring: its vector is repeated for few rows at a time.
                for first_row in range(0, max(1, len(at)), _VISIT_ROWS):
                    some = slice(first_row, first_row + _VISIT_ROWS)
                    yield own.iloc[at[some]].assign(block=block[some].astype("int32"))

    if not len(rings):
        return queries.limit(0).withColumn("block", F.lit(0))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInPandas(run, f"{fields}, block int")


def _meet(asked: DataFrame, docs: DataFrame, cell: Cell, schema: str, block_queries: int) -> DataFrame:
    """``cell`` on the queries and the documents of each ring; many queries of one ring are dealt to several tasks."""
    asked = materialize(asked)
    # One row per ring, of which there are at most MAX_BLOCKS.
    salts = materialize(asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("_salts")))
    q = asked.join(F.broadcast(salts), "block").withColumn("_salt", F.pmod(F.xxhash64("qid"), F.col("_salts")).cast("int"))
    d = docs.join(F.broadcast(salts.toDF("block", "_cuts")), "block")
    d = d.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)))
    # Fresh column identities: both sides may come from the same table.
    d = d.toDF(*d.columns)

    def run(own: pa.Table, held: pa.Table) -> pa.Table:
        return cell(own, held).drop_columns(["_row"])

    return q.groupBy("block", "_salt").cogroup(d.groupBy("block", "_salt")).applyInArrow(run, schema)


def _visit_count(queries: DataFrame, rings: Rings, weight: float) -> int:
    """The rows of ``visits`` to other than the best rings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, _CHUNK // max(1, len(rings)))
        for batch in batches:
            own = pa.Table.from_batches([batch])
            pieces = [own.slice(low, rows) for low in range(0, own.num_rows, rows)]
            yield pa.RecordBatch.from_pydict({"n": [int(_reached(p, rings, weight).sum()) for p in pieces]})

    counts = queries.select("vec", "_most", "_kth", "_home").mapInArrow(run, "n bigint")
    return counts.agg(F.sum("n")).first()[0] or 0


def _reached(own: pa.Table, rings: Rings, weight: float) -> np.ndarray:
    most, kth, home = (own[c].to_numpy() for c in ("_most", "_kth", "_home"))
    return rings.reached(unit_matrix(own["vec"]), weight, most, kth, home)


def _query_blocks(queries: DataFrame, rings: Rings, weight: float, block_queries: int) -> tuple[DataFrame, int]:
    """(packed blocks of queries whose best rings, in ``_home``, are neighbours, with the rings that any of them visits; their number)."""
    # At most MAX_BLOCKS rows.
    counts = sorted(tuple(r) for r in queries.groupBy("_home").count().collect())
    dealt, n_blocks, held = [], 0, block_queries
    for home, n in counts:
        parts = -(-n // block_queries)
        if parts > 1 or held + n > block_queries:
            n_blocks, held = n_blocks + parts, 0
        held += n if parts == 1 else block_queries
        dealt.append((home, n_blocks - parts, parts))
    table = queries.sparkSession.createDataFrame(dealt, "_home int, _first int, _parts int")
    number = F.col("_first") + F.pmod(F.xxhash64("qid"), F.col("_parts")).cast("int")
    rows = queries.join(F.broadcast(table), "_home").withColumn("_b", number).drop("_first", "_parts")
    packed = pack_blocks(rows, "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            needs = []
            for i in range(batch.num_rows):
                own, any_of = block_rows_of(batch["rows"], i), np.zeros(len(rings), bool)
                step = max(1, _CHUNK // len(rings))
                for low in range(0, own.num_rows, step):
                    any_of |= _reached(own.slice(low, step), rings, weight).any(axis=0)
                needs.append(np.flatnonzero(any_of).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(needs, pa.list_(pa.int32()))], names=["_b", "rows", "needs"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema)
    return materialize(packed.mapInArrow(run, f"{fields}, needs array<int>")), n_blocks


def _cross(
    asked: DataFrame, docs: DataFrame, n_asked: int, n_docs: int, cell: Cell, schema: str, k: int, rings: Rings | None, weight: float
) -> DataFrame:
    """``cell`` on pairs of packed blocks; for each query of a task the ``k`` best rows of all rings that it may need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # At most HELD_BLOCKS of queries: their rows, k-th scores and best documents so far.
        held: dict[int, tuple] = {}
        for ring, d, block, q in block_pairs(batches):
            if block not in held:
                kth = q["_kth"].to_numpy().copy() if rings is not None else np.zeros(q.num_rows)
                held[block] = q, kth, None
            q, kth, best = held[block]
            own = np.arange(q.num_rows)
            if rings is not None:
                bound = weight * rings.only(ring).bounds(unit_matrix(q["vec"]))[0][:, 0] + q["_most"].to_numpy()
                own = np.flatnonzero((bound + SLACK >= kth) & (bound > 0) & (q["_home"].to_numpy() != ring))
            some = q.drop_columns(["_kth"]) if rings is not None else q
            found = cell(some.take(pa.array(own)).append_column("_kth", pa.array(kth[own])), d)
            if not found.num_rows:
                continue
            found = found.set_column(found.column_names.index("_row"), "_row", pa.array(own[found["_row"].to_numpy()]))
            best = best_of_rows(found if best is None else pa.concat_tables([best, found]), k)
            row = best["_row"].to_numpy()
            # The last row of a query with k of them.
            last = np.flatnonzero(np.bincount(row, minlength=q.num_rows) == k)
            kth[last] = np.maximum(kth[last], best["score"].to_numpy()[np.searchsorted(row, last, "right") - 1])
            held[block] = q, kth, best
        for _, _, best in held.values():
            if best is not None:
                yield from best.drop_columns(["_row"]).to_batches()

    on = None if rings is None else F.array_contains("needs", F.col("_l"))
    return cross_blocks(docs, asked, n_docs, n_asked, run, schema, on)


def _sizes(rows: DataFrame) -> tuple[int, int]:
    """Rows, and numbers in their lists."""
    lists = [f.name for f in rows.schema if f.dataType.typeName() == "array"]
    numbers = sum((F.coalesce(F.size(c), F.lit(0)) for c in lists), F.lit(0))
    n, values = rows.agg(F.count(F.lit(1)), F.sum(numbers)).first()
    return n, values or 0


def _bounded(block_rows: int, rows: int, values: int) -> int:
    """Rows of a block of which the lists hold about MAX_VALUES numbers at most."""
    return max(1, min(block_rows, MAX_VALUES * rows // max(1, values)))


def ring_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    cell: Cell,
    schema: str,
    order_by: list,
    weight: float = 1.0,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """The ``k`` best documents per query, exactly; ``cell`` scores queries against documents and returns its k best.

    ``queries`` (qid, vec, _most, ...) and ``docs`` (doc_id, vec, ...) may carry columns that ``cell`` reads; its result is
    that of ``grid.best_in_cell``. The result is stored, as it is read more than once by most callers and each reading would
    run the cells; the tables made on the way are gone.
    """
    with scratch_scope(queries.sparkSession) as keep:
        queries = materialize(queries)
        (n_queries, asked_values), (n_docs, held_values) = _sizes(queries), _sizes(docs)
        block_queries, block_rows = _bounded(block_queries, n_queries, asked_values), _bounded(block_rows, n_docs, held_values)
        if n_docs <= block_rows:
            # One ring: nothing to skip.
            cuts = max(1, math.ceil(n_queries / min(block_queries, SMALL_QUERIES)))
            asked = pack_blocks(queries.withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(cuts)).cast("int")), "_b")
            held = pack_blocks(docs.withColumn("block", F.lit(0)), "block")
            return keep(top_k(_cross(asked, held, cuts, 1, cell, schema, k, None, weight), ["qid"], order_by, k))
        docs, rings = build_rings(docs, block_rows, max_pivots)
        asked = materialize(visits(queries, rings, weight, True))
        near = materialize(_meet(asked, docs, cell, schema, block_queries))
        kth = near.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_kth"))
        bounded = materialize(asked.join(kth, "qid", "left").fillna(0.0, ["_kth"]).withColumnRenamed("block", "_home"))
        if _visit_count(bounded, rings, weight) <= FEW_VISITS * n_queries:
            far = _meet(visits(bounded, rings, weight, False), docs, cell, schema, block_queries)
        else:
            blocks, n_blocks = _query_blocks(bounded, rings, weight, block_queries)
            held = materialize(pack_blocks(docs, "block"))
            far = _cross(blocks, held, n_blocks, len(rings), cell, schema, k, rings, weight)
        return keep(top_k(union_all([near, far]), ["qid"], order_by, k))
