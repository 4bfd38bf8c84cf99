"""Exact all-against-all work in bounded cells.

Some results need every left row compared with every right row (sparse or dense products,
exact silhouette). Both sides are cut into hash blocks and each cell of the
block grid is one group: it holds at most two blocks, returns only its own
reduced result (k best, or sums), and never the pairs. Up to the bounds of a block
their number is fixed, so each row is sent as often however large the table is. Where every cell runs at
once, each block is one row and pairs of rows are joined: no row is sent more than once (see ``cross_blocks``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The most rows, and numbers in arrays of them, that a block holds.
MAX_ROWS = 1 << 16
MAX_VALUES = 1 << 22
# The most cells of a wave: enough for the cores of a small cluster, few enough for its disks.
WAVE_CELLS = 12
# Scores of a cell that are held at once.
CELL_SCORES = 1 << 22
# Tasks of a crossing where there are blocks enough, blocks that stream through one of them, and those that it holds.
CROSS_TASKS = 64
STREAMED_BLOCKS = 32
HELD_BLOCKS = 4
HELD_PARTS = 256
# Rows of a result that leave a crossing at once.
OUT_ROWS = 1 << 16
# Queries of a cell that are scored at once.
PIECE_ROWS = 256

Cell = Callable[[pa.Table, pa.Table], pa.Table]


def block_count(n_rows: int, block_rows: int) -> int:
    return max(1, math.ceil(n_rows / block_rows))


def few_blocks(n_rows: int, n_values: int, block_rows: int, most: int) -> int:
    """Blocks of ``block_rows`` rows, ``most`` of them unless one would pass MAX_ROWS or MAX_VALUES."""
    least = max(block_count(n_rows, MAX_ROWS), block_count(n_values, MAX_VALUES))
    return max(least, min(block_count(n_rows, block_rows), most))


def cheap_blocks(
    left: tuple[int, int], right: tuple[int, int], left_block: int, right_block: int, cells: int, left_back: int = 0
) -> tuple[int, int]:
    """Blocks of both sides for which the fewest numbers are sent.

    ``left`` and ``right`` are (rows, numbers in arrays of them). Each left row is sent to every right block, which
    returns ``left_back`` numbers for it, and each right row to every left block. There are about ``cells`` cells: fewer
    where blocks would fall below the given rows, more where one would pass MAX_ROWS or MAX_VALUES.
    """
    (l_rows, l_values), (r_rows, r_values) = left, right
    l_least = max(block_count(l_rows, MAX_ROWS), block_count(l_values, MAX_VALUES))
    r_least = max(block_count(r_rows, MAX_ROWS), block_count(r_values, MAX_VALUES))
    l_most, r_most = max(l_least, block_count(l_rows, left_block)), max(r_least, block_count(r_rows, right_block))
    wanted = min(cells, l_most * r_most)
    pairs = [(n, max(r_least, math.ceil(wanted / n))) for n in range(l_least, l_most + 1)]
    return min(
        [p for p in pairs if p[1] <= r_most],
        key=lambda p: ((l_values + l_rows * left_back) * p[1] + r_values * p[0], p),
    )


def _every(blocks: range):
    return F.explode(F.sequence(F.lit(blocks[0]), F.lit(blocks[-1])))


def grid_apply(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    n_left: int,
    n_right: int,
    cell: Cell,
    schema: str,
    only: range | None = None,
    only_right: range | None = None,
) -> DataFrame:
    """Run ``cell`` on every (left block, right block), or on those of the left blocks ``only`` and the right ones ``only_right``.

    Chosen cells are shuffled, each row to those of its block. All cells together would send each row to every block of the
    other side, so there the blocks are joined instead.
    """
    # Fresh column identities: both sides may come from the same table.
    right = right.toDF(*right.columns)
    l = left.withColumn("_lb", F.pmod(F.xxhash64(left_id), F.lit(n_left)).cast("int"))
    r = right.withColumn("_rb", F.pmod(F.xxhash64(right_id), F.lit(n_right)).cast("int"))
    if only is None and only_right is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, q, _, d in block_pairs(batches):
                yield from cell(q, d).to_batches(OUT_ROWS)

        return cross_blocks(pack_blocks(l, "_lb"), pack_blocks(r, "_rb"), n_left, n_right, run, schema)
    if only is not None:
        l = l.where(F.col("_lb").between(only[0], only[-1]))
    if only_right is not None:
        r = r.where(F.col("_rb").between(only_right[0], only_right[-1]))
    l = l.withColumn("_rb", _every(range(n_right) if only_right is None else only_right))
    r = r.withColumn("_lb", _every(range(n_left) if only is None else only))
    return _meet(l, r, cell, schema)


def pack_blocks(rows: DataFrame, block: str, *more: Column) -> DataFrame:
    """One row per block: its number, its rows as a list ``rows``, and further aggregates."""
    return rows.groupBy(block).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != block])).alias("rows"), *more)


def cross_blocks(
    left: DataFrame, right: DataFrame, n_left: int, n_right: int, run, schema: str, on: Column | None = None
) -> DataFrame:
    """``run`` on batches of block pairs, all or those that ``on`` allows; tables as from ``pack_blocks``, block number first.

    Both sides are shuffled once, as they are. A task streams the left blocks of one partition past the few right blocks
    that it holds, which are the same for every left block.
    """
    r_parts = max(min(n_right, HELD_PARTS), math.ceil(n_right / HELD_BLOCKS))
    l_parts = min(n_left, max(math.ceil(CROSS_TASKS / r_parts), math.ceil(n_left / STREAMED_BLOCKS)))
    l, r = left.toDF("_l", "_left", *left.columns[2:]), right.toDF("_r", "_right", *right.columns[2:])
    l = l.repartitionById(l_parts, F.pmod("_l", F.lit(l_parts))).hint("shuffle_replicate_nl")
    r = r.repartitionById(r_parts, F.pmod("_r", F.lit(r_parts)))
    pairs = l.crossJoin(r) if on is None else l.join(r, on)
    return pairs.select("_l", "_left", "_r", "_right").mapInArrow(run, schema)


def block_rows_of(lists: pa.Array, i: int) -> pa.Table:
    """The rows of the ``i``-th block of a column of lists."""
    rows = lists.slice(i, 1).flatten()
    return pa.Table.from_arrays(rows.flatten(), names=[rows.type.field(c).name for c in range(rows.type.num_fields)])


def block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, int, pa.Table]]:
    """(number, rows) of the left and of the right block of each pair."""
    for batch in batches:
        l, left, r, right = batch.columns
        for i in range(batch.num_rows):
            yield l[i].as_py(), block_rows_of(left, i), r[i].as_py(), block_rows_of(right, i)


def waves(n_left: int, n_right: int) -> list[tuple[range, range]]:
    """(left blocks, right blocks) of each turn, at most WAVE_CELLS cells: the disks then hold what one turn sends, not what
    the whole grid does."""
    step, width = max(1, WAVE_CELLS // n_right), math.ceil(n_right / math.ceil(n_right / WAVE_CELLS))
    lefts = [range(low, min(n_left, low + step)) for low in range(0, n_left, step)]
    rights = [range(low, min(n_right, low + width)) for low in range(0, n_right, width)]
    return [(l, r) for l in lefts for r in rights]


def triangle_apply(rows: DataFrame, row_id: str, n: int, cell: Cell, schema: str) -> DataFrame:
    """Run ``cell`` on every two blocks of one table, and on each block with itself.

    The tables of a cell have the columns ``_lb`` and ``_rb``, equal where a block meets itself.
    """
    block = F.pmod(F.xxhash64(row_id), F.lit(n)).cast("int")
    l = rows.withColumn("_lb", block).withColumn("_rb", F.explode(F.sequence(F.col("_lb"), F.lit(n - 1))))
    r = rows.toDF(*rows.columns).withColumn("_rb", block).withColumn("_lb", F.explode(F.sequence(F.lit(0), F.col("_rb"))))
    return _meet(l, r, cell, schema)


def _meet(left: DataFrame, right: DataFrame, cell: Cell, schema: str) -> DataFrame:
    keys = [F.col("_lb").cast("int"), F.col("_rb").cast("int")]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)


def flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(values, bounds) of a column of lists; a null list is empty."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate([[0], np.cumsum(length)]).astype(np.int64)


@dataclass(frozen=True)
class Postings:
    """Places and weights of the features of a block: feature f has ``place[start[f]:start[f + 1]]``."""

    start: np.ndarray
    place: np.ndarray
    w: np.ndarray
    n_places: int

    @classmethod
    def of(cls, feature: np.ndarray, bounds: np.ndarray, w: np.ndarray, n_features: int) -> Postings:
        """From rows of feature numbers and weights; negative numbers are left out."""
        place = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        known = np.flatnonzero(feature >= 0)
        known = known[np.argsort(feature[known], kind="stable")]
        start = np.searchsorted(feature[known], np.arange(n_features + 1))
        return cls(start, place[known], w[known], len(bounds) - 1)

    def dot(self, feature: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each place, the sum of weight * w over the given features."""
        first = self.start[feature]
        n = self.start[feature + 1] - first
        shift = np.repeat(first - (np.cumsum(n) - n), n)
        at = np.arange(len(shift)) + shift
        return np.bincount(self.place[at], np.repeat(weight, n) * self.w[at], self.n_places)


def meeting(q: pa.Table, d: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, Postings]:
    """(feature numbers of the queries, their bounds, their weights, the features by number, postings of the documents)."""
    asked, q_bounds = flat(q["feature"])
    qw = flat(q["qw"])[0].to_numpy(zero_copy_only=False)
    coded = asked.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    held, d_bounds = flat(d["feature"])
    found = pc.fill_null(pc.index_in(held, value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False)
    postings = Postings.of(found, d_bounds, flat(d["w"])[0].to_numpy(zero_copy_only=False), len(coded.dictionary))
    return codes, q_bounds, qw, coded.dictionary, postings


def pairs_cell(q: pa.Table, d: pa.Table) -> pa.Table:
    """A cell as ``sparse_cell`` that returns the score of every pair with one above 0, so its blocks must be small."""
    codes, q_bounds, qw, _, postings = meeting(q, d)
    places, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
    for i in range(q.num_rows if d.num_rows else 0):
        score = postings.dot(codes[q_bounds[i] : q_bounds[i + 1]], qw[q_bounds[i] : q_bounds[i + 1]])
        hits = np.flatnonzero(score > 0)
        places.append(hits)
        scores.append(score[hits])
    row = np.repeat(np.arange(len(places) - 1), [len(hits) for hits in places[1:]])
    qids, doc_ids = q["qid"].take(pa.array(row)), d["doc_id"].take(pa.array(np.concatenate(places)))
    return pa.table({"qid": qids, "doc_id": doc_ids, "score": pa.array(np.concatenate(scores))})


def sparse_cell(k: int, parts: dict[str, str]) -> Cell:
    """A cell for rows (qid, feature, qw) and (doc_id, feature, w) with lists: the ``k`` best positive
    scores per query, ties to the smaller doc id, and the share of each feature prefix in ``parts``."""

    def cell(q: pa.Table, d: pa.Table) -> pa.Table:
        # Places then follow the ids, nulls first as in Spark's order.
        d = by_id(d)
        codes, q_bounds, qw, known, postings = meeting(q, d)
        part_of = np.zeros(len(known), np.int64)
        for i, prefix in enumerate(parts.values()):
            part_of[pc.starts_with(known, prefix).to_numpy(zero_copy_only=False)] = i
        rows, places, scores, shares = [], [], [], []
        for i in range(q.num_rows if d.num_rows else 0):
            own, weight = codes[q_bounds[i] : q_bounds[i + 1]], qw[q_bounds[i] : q_bounds[i + 1]]
            each = [part_of[own] == p for p in range(len(parts))] or [slice(None)]
            earned = [postings.dot(own[e], weight[e]) for e in each]
            score = sum(earned[1:], earned[0])
            best = best_places(score, k)
            rows.append(np.full(len(best), i))
            places.append(best)
            scores.append(score[best])
            shares.append([e[best] for e in earned])
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        place = np.concatenate(places) if rows else np.zeros(0, np.int64)
        out = {"qid": q["qid"].take(pa.array(row)), "doc_id": d["doc_id"].take(pa.array(place))}
        out["score"] = pa.array(np.concatenate(scores) if rows else np.zeros(0))
        for p, name in enumerate(parts):
            out[name] = pa.array(np.concatenate([s[p] for s in shares]) if rows else np.zeros(0))
        return pa.table(out)

    return cell


def best_places(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores above 0, at nine digits; the smaller place on ties."""
    least = 0.0
    if k < len(score):
        least = max(0.0, float(np.partition(score, len(score) - k)[len(score) - k]) - 1e-8)
    at = np.flatnonzero(score >= least) if least else np.flatnonzero(score > 0)
    rounded = np.round(score[at], 9)
    at, rounded = at[rounded > 0], rounded[rounded > 0]
    return at[np.argsort(-rounded, kind="stable")][:k]


def unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(float)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def unit_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column at length 1; zeros for those that are null, of length 0 or not finite."""
    values, bounds = flat(column)
    n = np.diff(bounds)
    width = int(n.max()) if len(n) else 0
    if (n[n > 0] != width).any():
        raise ValueError("vectors differ in length")
    m = np.zeros((len(n), width))
    m[n > 0] = values.to_numpy(zero_copy_only=False).reshape(-1, width) if width else 0.0
    with np.errstate(all="ignore"):
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        m /= np.where(norms == 0, 1.0, norms)
    m[~np.isfinite(m).all(axis=1)] = 0.0
    return m


def by_id(d: pa.Table) -> pa.Table:
    """Documents in the order of their ids, nulls first as in Spark's order."""
    return d.take(pc.sort_indices(d, [("doc_id", "ascending")], null_placement="at_start"))


def best_in_cell(
    q: pa.Table,
    d: pa.Table,
    k: int,
    scores: Callable[[slice], np.ndarray],
    exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
    slack: float = 0.0,
) -> pa.Table:
    """(qid, doc_id, score, _row): per query, of number ``_row``, the ``k`` best positive scores, ties to the earlier document.

    ``scores`` gives the scores of a slice of the queries with all documents. They may be off by ``slack``; ``exact`` then
    gives those of the (queries, documents) that may count. Scores below a query's ``_kth``, if it has one, are left out.
    """
    n_docs = d.num_rows
    kth = q["_kth"].to_numpy() if "_kth" in q.column_names else np.zeros(q.num_rows)
    step = max(1, min(PIECE_ROWS, CELL_SCORES // max(1, n_docs)))
    rows, places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for low in range(0, q.num_rows if n_docs else 0, step):
        piece = scores(slice(low, low + step))
        least = kth[low : low + step].copy()
        unknown = np.flatnonzero(least <= 0)
        if len(unknown) and k < n_docs:
            least[unknown] = np.partition(piece[unknown], n_docs - k, axis=1)[:, n_docs - k] - slack
        # Nothing of 0 counts, so without slack only what is above it is looked at.
        least = np.maximum(least - slack - 1e-8, -slack if slack else 1e-10)
        hits = np.flatnonzero(piece >= least[:, None].astype(piece.dtype))
        row, place = hits // n_docs, hits % n_docs
        score = piece.ravel()[hits] if exact is None else exact(row + low, place)
        rounded = np.round(score, 9)
        some = np.flatnonzero(rounded > 0)
        some = some[np.lexsort((place[some], -rounded[some], row[some]))]
        some = some[_first_of_each(row[some], k)]
        rows.append(row[some] + low)
        places.append(place[some])
        found.append(score[some])
    row = np.concatenate(rows)
    out = {"qid": q["qid"].take(pa.array(row)), "doc_id": d["doc_id"].take(pa.array(np.concatenate(places)))}
    return pa.table(out | {"score": pa.array(np.concatenate(found)), "_row": pa.array(row)})


def _first_of_each(key: np.ndarray, k: int) -> np.ndarray:
    """Whether a place is among the first ``k`` of its key; equal keys lie together."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key)))) < k


def best_of_rows(hits: pa.Table, k: int) -> pa.Table:
    """The ``k`` best of each ``_row`` of results of ``best_in_cell``, which may come from several cells."""
    order = hits.append_column("_neg", pa.array(-np.round(hits["score"].to_numpy(), 9)))
    keys = [("_row", "ascending"), ("_neg", "ascending"), ("doc_id", "ascending")]
    hits = hits.take(pc.sort_indices(order, keys, null_placement="at_start"))
    return hits.filter(pa.array(_first_of_each(hits["_row"].to_numpy(), k)))
