"""Approximate nearest neighbours by inner product: a hash-prefix forest.

Each tree gives a vector a hash string of ``DEPTH`` digits. A digit is the axis of a random rotation that the
vector lies nearest to, with its sign. A tree is the sorted array of its strings: the vectors that share a
prefix with a query are one range of it. A query descends to its longest match in every tree and then
ascends in all trees together, one digit at a time, until the ranges hold enough candidates; these are
scored where they lie. How many are enough is fitted on a bounded sample of queries, whose true
neighbours are searched in all rows, so that the target recall holds for any table. At the root,
every row is a candidate.

Trees are cut into parts of consecutive first digits; a digit with too many rows or queries is dealt to
several parts, so no task holds more than a bounded number of rows and queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlova.operators.ranking import top_k
from parlova.runtime import materialize

TREES = 40
# Digits of a hash string. A string is kept in 64 bits: eight digits of vectors up to 127 long, else four.
DEPTH = 6
NEIGHBOURS = 20
# The fit: queries searched exactly, and the share of their neighbours that must be candidates.
SAMPLE_QUERIES = 400
TARGET_RECALL = 0.94
# Most rows, and most queries, of a part.
PART_ROWS = 60_000
PART_QUERIES = 20_000
_SEED = 20_240_601
_CHUNK = 1 << 22


# -- vectors ----------------------------------------------------------------------------------


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of numbers, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def inner_product(a: Column, b: Column) -> Column:
    """The sum of products in double precision, from the first component to the last."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """``cls, vector, members``: each distinct vector with its ``keep`` smallest ids, the least being ``cls``.

    Of equal vectors only the smallest ids can be among the nearest, so a vector that very many rows share
    is searched once. Only ``keep`` rows of it leave any task.
    """
    nth = Window.partitionBy("vector").orderBy("id")
    first = rows.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= keep)
    found = first.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return found.select(F.get("members", F.lit(0)).alias("cls"), "vector", "members")


# -- hash strings -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Hasher:
    """Random rotations of one extra dimension, which makes lengths equal.

    A row x becomes (x, sqrt(longest^2 - |x|^2)) / longest, a query q becomes (q, 0) / |q|: then the nearest by
    angle are the nearest by inner product.
    """

    dim: int
    longest: float
    trees: int
    depth: int

    @property
    def n_digits(self) -> int:
        return 2 * (self.dim + 1)

    @property
    def digit(self) -> np.dtype:
        return np.dtype(np.uint8 if self.n_digits <= 256 else np.uint16)

    def rotations(self) -> np.ndarray:
        shape = (self.trees, self.depth, self.dim + 1, self.dim + 1)
        return np.linalg.qr(np.random.default_rng([_SEED, self.dim]).standard_normal(shape))[0].astype(np.float32)

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64) / self.longest
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))
        return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)

    def queries(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64) / np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        return np.concatenate([x, np.zeros((len(x), 1))], axis=1).astype(np.float32)

    def strings(self, points: np.ndarray, rotations: np.ndarray) -> np.ndarray:
        """(point, tree, digit)."""
        out = np.zeros((len(points), self.trees, self.depth), self.digit)
        each = np.arange(len(points))
        for tree in range(self.trees):
            for d in range(self.depth):
                turned = points @ rotations[tree, d]
                axis = np.argmax(np.abs(turned), axis=1)
                out[:, tree, d] = 2 * axis + (turned[each, axis] > 0)
        return out

    def unpacked(self, strings: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(strings), self.digit).reshape(-1, self.trees, self.depth)

    def keys(self, strings: np.ndarray) -> np.ndarray:
        """Strings as numbers of the same order, the first digit highest."""
        bits = np.uint64(8 * self.digit.itemsize)
        out = np.zeros(strings.shape[:-1], np.uint64)
        for d in range(self.depth):
            out = (out << bits) | strings[..., d].astype(np.uint64)
        return out

    def ranges(self, ordered: np.ndarray, wanted: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of a sorted array of keys that shares the first ``level`` digits with each wanted key."""
        return prefix_ranges(ordered, wanted, level, 8 * self.digit.itemsize * (self.depth - level))


def prefix_ranges(ordered: np.ndarray, wanted: np.ndarray, level: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of a sorted array that agrees with each wanted number above its last ``rest`` bits; all of it at level 0."""
    whole = level == 0
    shift = np.where(whole, 0, rest).astype(np.uint64)
    low = (wanted >> shift) << shift
    last = low | ((np.uint64(1) << shift) - np.uint64(1))
    start = np.where(whole, 0, np.searchsorted(ordered, low, "left"))
    stop = np.where(whole, len(ordered), np.searchsorted(ordered, last, "right"))
    return start, stop


# -- parts ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Parts:
    """For every tree and first digit: its first part, and how many parts its rows and its queries are dealt to.

    The tables have trees * 2 * (dimensions + 1) entries, whatever the number of rows.
    """

    first: np.ndarray
    by_rows: np.ndarray
    by_queries: np.ndarray

    @staticmethod
    def plan(rows: np.ndarray, queries: np.ndarray) -> Parts:
        first, n = np.zeros(rows.shape, np.int64), 0
        by_rows = np.maximum(1, -(-rows // PART_ROWS))
        by_queries = np.maximum(1, -(-queries // PART_QUERIES))
        for tree in range(rows.shape[0]):
            current, held, asked = -1, 0, 0
            for digit in range(rows.shape[1]):
                cuts = by_rows[tree, digit] * by_queries[tree, digit]
                own = rows[tree, digit], queries[tree, digit]
                if cuts > 1:
                    first[tree, digit] = n
                    n, current = n + cuts, -1
                    continue
                if current < 0 or held + own[0] > PART_ROWS or asked + own[1] > PART_QUERIES:
                    current, held, asked = n, 0, 0
                    n += 1
                first[tree, digit] = current
                held, asked = held + own[0], asked + own[1]
        return Parts(first, by_rows, by_queries)

    def of_rows(self, tree: int, digit: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, part): a row goes to one cut of the rows, once for every cut of the queries."""
        which, nth = _repeated(self.by_queries[tree, digit])
        cut = (salt % self.by_rows[tree, digit])[which]
        return which, self.first[tree, digit][which] + cut * self.by_queries[tree, digit][which] + nth

    def of_queries(self, tree: int, digit: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, part): a query goes to one cut of the queries, once for every cut of the rows."""
        which, nth = _repeated(self.by_rows[tree, digit])
        cuts = self.by_queries[tree, digit][which]
        return which, self.first[tree, digit][which] + nth * cuts + salt[which] % cuts


def _repeated(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    which = np.repeat(np.arange(len(times)), times)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)


def _salt(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


# -- search -----------------------------------------------------------------------------------


def _hashed(rows: DataFrame, hasher: Hasher, queries: bool) -> DataFrame:
    """``cls, strings, codes, scale``: strings of all trees, and components in one signed byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            rotations = hasher.rotations() if rotations is None else rotations
            strings = hasher.strings(hasher.queries(x) if queries else hasher.rows(x), rotations)
            scale = np.abs(x).max(axis=1).astype(np.float64) / 127
            codes = np.rint(x / scale[:, None]).astype(np.int8)
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([s.tobytes() for s in strings], pa.binary()),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(scale),
                ],
                names=["cls", "strings", "codes", "scale"],
            )

    return rows.select("cls", "vector").mapInArrow(run, "cls bigint, strings binary, codes binary, scale double")


def _first_digits(hashed: DataFrame, hasher: Hasher) -> np.ndarray:
    """Rows by tree and first digit; the table has a bounded number of entries."""
    n_digits = hasher.n_digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((hasher.trees, n_digits), np.int64)
        for batch in batches:
            strings = hasher.unpacked(batch.column(0).to_pylist())
            for tree in range(hasher.trees):
                total[tree] += np.bincount(strings[:, tree, 0], minlength=n_digits)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    found = hashed.select("strings").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(hasher.trees * n_digits, np.int64)
    for at, n in found:
        out[at] = n
    return out.reshape(hasher.trees, n_digits)


def _deal_rows(hashed: DataFrame, hasher: Hasher, parts: Parts, codes: bool) -> DataFrame:
    """One row per tree and part that a vector goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings, ids = hasher.unpacked(batch.column(1).to_pylist()), batch.column(0).to_numpy()
            keys, salt = hasher.keys(strings), _salt(ids)
            for tree in range(hasher.trees):
                which, part = parts.of_rows(tree, strings[:, tree, 0].astype(np.int64), salt)
                columns = [pa.array(part), pa.array(keys[which, tree].view(np.int64))]
                names = ["part", "key"]
                if codes:
                    columns += [batch.column(i).take(pa.array(which)) for i in (0, 2, 3)]
                    names += ["cls", "codes", "scale"]
                yield pa.record_batch(columns, names=names)

    schema = "part bigint, key bigint" + (", cls bigint, codes binary, scale double" if codes else "")
    return hashed.mapInArrow(run, schema)


def _deal_queries(queries: DataFrame, hasher: Hasher, parts: Parts, levels: bool) -> DataFrame:
    """One row per part that a query asks: those of its first digit in each tree, or from the root all of the first tree."""
    everywhere = np.arange(parts.first.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings, ids = hasher.unpacked(batch.column(1).to_pylist()), batch.column(0).to_numpy()
            keys, salt = hasher.keys(strings), _salt(ids)
            level = batch.column(3).to_numpy() if levels else np.full(len(ids), 1)
            for tree in range(hasher.trees):
                use = np.flatnonzero(level > 0)
                digit = strings[use, tree, 0].astype(np.int64)
                if tree == 0:
                    root = np.repeat(np.flatnonzero(level == 0), len(everywhere))
                    use = np.concatenate([use, root])
                    digit = np.concatenate([digit, np.tile(everywhere, len(root) // len(everywhere))])
                which, part = parts.of_queries(tree, digit, salt[use])
                which = use[which]
                if tree == 0 and len(root):
                    # Several digits in one part ask it once.
                    which, part = np.unique(np.stack([which, part]), axis=1)
                columns = [pa.array(part), batch.column(0).take(pa.array(which)), pa.array(keys[which, tree].view(np.int64))]
                names = ["part", "query", "key"]
                if levels:
                    columns += [batch.column(i).take(pa.array(which)) for i in (2, 3)]
                    names += ["vector", "level"]
                yield pa.record_batch(columns, names=names)

    schema = "part bigint, query bigint, key bigint" + (", vector array<float>, level int" if levels else "")
    return queries.mapInArrow(run, schema)


def _count_matches(hasher: Hasher):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ordered = np.sort(rows["key"].to_numpy().view(np.uint64))
        wanted = asked["key"].to_numpy().view(np.uint64)
        counts = np.zeros((len(wanted), hasher.depth), np.int64)
        for level in range(1, hasher.depth + 1):
            start, stop = hasher.ranges(ordered, wanted, np.full(len(wanted), level))
            counts[:, level - 1] = stop - start
        return pa.table({"query": asked["query"], **{f"n{x + 1}": counts[:, x] for x in range(hasher.depth)}})

    return run


def _score(hasher: Hasher, k: int):
    """For each query of a part, the candidates that can be among its ``k`` best there, by rounded components.

    A rounded component is off by half a step at most, which bounds the error of a score; all within the
    bound of the k-th best go on, so rounding loses none.
    """

    types = {"query": np.int64, "cls": np.int64, "score": np.float64, "slack": np.float64}

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.table({n: np.zeros(0, t) for n, t in types.items()})
        key = rows["key"].to_numpy().view(np.uint64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        ids = rows["cls"].to_numpy()[order]
        scale = rows["scale"].to_numpy()[order]
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.int8).reshape(len(key), -1)[order]
        wanted = asked["key"].to_numpy().view(np.uint64)
        level = asked["level"].to_numpy().astype(np.int64)
        vectors = matrix(asked["vector"].combine_chunks()).astype(np.float32)
        query = asked["query"].to_numpy()
        weight = np.abs(vectors.astype(np.float64)).sum(axis=1)
        start, stop = hasher.ranges(key, wanted, level)
        # Queries of one range are multiplied together.
        turn = np.lexsort((stop, start))
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(start[turn]) != 0) | (np.diff(stop[turn]) != 0), [True]]))
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            low, high = int(start[turn[a]]), int(stop[turn[a]])
            if low == high:
                continue
            block = codes[low:high].astype(np.float32) * scale[low:high, None].astype(np.float32)
            worst = scale[low:high].max()
            many = max(1, _CHUNK // (high - low))
            for c in range(a, b, many):
                own = turn[c : min(b, c + many)]
                scores = vectors[own] @ block.T
                if high - low > k:
                    kth = np.partition(scores, high - low - k, axis=1)[:, high - low - k]
                    slack = 1.001 * weight[own] * worst + 1e-5 * np.abs(kth)
                    at, column = np.nonzero(scores >= (kth - slack)[:, None])
                else:
                    at, column = (x.ravel() for x in np.indices(scores.shape))
                out.append((query[own[at]], ids[low + column], scores[at, column], 0.5005 * weight[own[at]] * scale[low + column]))
        found = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0)] * 4
        return pa.table({n: v.astype(t) for v, (n, t) in zip(found, types.items())})

    return run


def _true_neighbours(classes: DataFrame, sample: pd.DataFrame, k: int) -> DataFrame:
    """The exact ``k`` best other classes of the sampled queries: a bounded set against all rows, in blocks."""
    ids = sample["cls"].to_numpy()
    vectors = np.stack(sample["vector"].to_numpy()).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ids = np.zeros((len(ids), 0), np.int64)
        best = np.zeros((len(ids), 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            scores = vectors @ matrix(batch.column(1)).astype(np.float64).T
            scores[ids[:, None] == own[None, :]] = -np.inf
            best = np.concatenate([best, scores], axis=1)
            best_ids = np.concatenate([best_ids, np.broadcast_to(own, scores.shape)], axis=1)
            if best.shape[1] > k:
                at = np.argpartition(-best, k - 1, axis=1)[:, :k]
                best, best_ids = np.take_along_axis(best, at, 1), np.take_along_axis(best_ids, at, 1)
        real = np.isfinite(best)
        yield pa.record_batch(
            [pa.array(np.repeat(ids, real.sum(axis=1))), pa.array(best_ids[real]), pa.array(best[real])], names=["query", "cls", "score"]
        )

    found = classes.select("cls", "vector").mapInArrow(run, "query bigint, cls bigint, score double")
    return top_k(found, ["query"], [F.col("score").desc(), F.col("cls")], k)


def enough(counts: np.ndarray, reach: np.ndarray, query: np.ndarray, target: float) -> float:
    """The least number of candidates at which the sampled queries reach the target recall, else infinity.

    ``counts[q, x - 1]`` rows share x digits with query q, summed over the trees; neighbour i of the query
    ``query[i]`` shares at most ``reach[i]`` digits in any tree. Asking for more candidates lowers
    levels, so recall only grows.
    """
    per_query = np.maximum(1, np.bincount(query, minlength=len(counts)))
    asked = np.unique(query)

    def recall(m: float) -> float:
        level = (counts >= m).sum(axis=1)
        found = np.bincount(query, weights=reach >= level[query], minlength=len(counts))
        return float((found / per_query)[asked].mean()) if len(asked) else 1.0

    steps = np.unique(counts)
    low, high = 0, len(steps)
    while low < high:
        middle = (low + high) // 2
        if recall(float(steps[middle])) >= target:
            high = middle
        else:
            low = middle + 1
    return float(steps[low]) if low < len(steps) else float("inf")


def nearest(
    table: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = NEIGHBOURS,
    trees: int = TREES,
    depth: int = DEPTH,
    sample_queries: int = SAMPLE_QUERIES,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every query row the ``k`` rows nearest by inner product that the forest finds.

    Rows come nearest first, equal scores by the smaller id, without the query's own row. Rows of one id and
    one vector count once; of rows with one id and several vectors each is searched, and none of that id is returned
    to it. Null ids, and vectors that are null, empty, zero, of another length than most (ties: the longer),
    or hold null or non-finite components take no part. With ``k`` other rows or fewer, all are returned. An empty table
    gives no rows; other columns are not read.
    """
    spark = table.sparkSession
    vector = F.col(f"`{vector_col}`").cast("array<float>")
    ids = F.col(f"`{id_col}`").cast("bigint")
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = table.select(ids.alias("id"), vector.alias("vector"), is_query.alias("asks")).where(ids.isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0].dim
    rows = rows.where(F.size("vector") == dim).dropDuplicates(["id", "vector"])
    rows = materialize(rows)
    # One more than k: the query itself is left out at the end.
    classes = materialize(distinct_vectors(rows.select("id", "vector"), k + 1))
    asking = rows.where("asks").groupBy("vector").agg(F.min("id").alias("asker"))
    queries = materialize(classes.select("cls", "vector").join(asking.select("vector"), "vector", "left_semi"))
    length = F.sqrt(inner_product(F.col("vector"), F.col("vector")))
    depth = min(depth, 8 if dim < 128 else 4)
    hasher = Hasher(dim, classes.agg(F.max(length).alias("n")).first().n, trees, depth)
    hashed = materialize(_hashed(classes, hasher, False))
    asked = materialize(_hashed(queries, hasher, True).select("cls", "strings"))
    n_rows, n_queries = _first_digits(hashed, hasher), _first_digits(asked, hasher)

    # Descend: how many rows share 1, 2, ... digits with each query, over all trees.
    parts = Parts.plan(n_rows, n_queries)
    light = _deal_rows(hashed.select("cls", "strings"), hasher, parts, False).groupBy("part")
    wanted = _deal_queries(asked, hasher, parts, False).groupBy("part")
    counts = [f"n{x}" for x in range(1, depth + 1)]
    matches = light.cogroup(wanted).applyInArrow(_count_matches(hasher), "query bigint, " + ", ".join(f"{c} bigint" for c in counts))
    matches = materialize(matches.groupBy("query").agg(*[F.sum(c).alias(c) for c in counts]))

    # How many candidates are enough, from the sample.
    m = _fitted(classes, queries, hashed, asked, matches, hasher, k, sample_queries, target_recall)

    # Ascend to the level that holds as many, in all trees, and score there.
    level = sum((F.col(c) >= m).cast("int") for c in counts).alias("level")
    ready = queries.join(asked, "cls").join(matches.select(F.col("query").alias("cls"), level), "cls")
    ready = materialize(ready.select("cls", "strings", "vector", "level"))
    n_queries = _first_digits(ready.where("level > 0"), hasher)
    n_queries[0] += ready.where("level = 0").count()
    parts = Parts.plan(n_rows, n_queries)
    data = _deal_rows(hashed, hasher, parts, True).groupBy("part")
    wanted = _deal_queries(ready, hasher, parts, True).groupBy("part")
    scored = data.cogroup(wanted).applyInArrow(_score(hasher, k + 1), "query bigint, cls bigint, score double, slack double")
    return _ranked(rows, classes, queries, scored, k)


def _fitted(classes, queries, hashed, asked, matches, hasher: Hasher, k: int, sample_queries: int, target: float) -> float:
    """The number of candidates that the sampled queries need; what reaches the driver is bounded by the sample."""
    sample = queries.orderBy(F.xxhash64("cls"), "cls").limit(sample_queries).toPandas()
    if sample.empty:
        return 1.0
    true = _true_neighbours(classes, sample, k).select("query", "cls").toPandas()
    if true.empty:
        return 1.0
    near = classes.sparkSession.createDataFrame(pd.DataFrame({"cls": true["cls"].unique()}))
    own = classes.sparkSession.createDataFrame(sample[["cls"]])
    theirs = hashed.join(F.broadcast(near), "cls").select("cls", "strings").toPandas()
    mine = asked.join(F.broadcast(own), "cls").toPandas()
    n = matches.join(F.broadcast(own.withColumnRenamed("cls", "query")), "query").toPandas().set_index("query").loc[mine["cls"]].to_numpy()

    at_query = pd.Series(range(len(mine)), mine["cls"]).loc[true["query"]].to_numpy()
    at_row = pd.Series(range(len(theirs)), theirs["cls"]).loc[true["cls"]].to_numpy()
    same = hasher.unpacked(list(mine["strings"]))[at_query] == hasher.unpacked(list(theirs["strings"]))[at_row]
    reach = np.cumprod(same, axis=2).sum(axis=2).max(axis=1)
    return enough(n, reach, at_query, target)


def _ranked(rows: DataFrame, classes: DataFrame, queries: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query row, from candidates with rounded scores."""
    # A candidate comes from several trees with one score; those below the k-th best by more than the bounds go.
    found = scored.groupBy("query", "cls").agg(F.max("score").alias("score"), F.max("slack").alias("slack"))
    found = materialize(found)
    kth = top_k(found.withColumn("least", F.col("score") - F.col("slack")), ["query"], [F.col("least").desc(), F.col("cls")], k + 1)
    # With k + 1 classes or fewer, all stay: the bound is the least of them.
    bound = kth.groupBy("query").agg(F.min("least").alias("bound"))
    close = found.join(bound, "query").where(F.col("score") + F.col("slack") + 1e-5 * F.abs("bound") >= F.col("bound"))
    pairs = (
        close.select("query", "cls")
        .join(classes, "cls")
        .join(queries.select(F.col("cls").alias("query"), F.col("vector").alias("asked")), "query")
        .select("query", inner_product(F.col("asked"), F.col("vector")).alias("score"), F.explode("members").alias("vec_id"))
    )
    best = top_k(pairs, ["query"], [F.col("score").desc(), F.col("vec_id")], k + 1)
    best = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best"))
    # Query rows of one vector share the list; each leaves out itself.
    askers = rows.where("asks").join(queries.select("vector", F.col("cls").alias("query")), "vector").select("query", F.col("id").alias("query_id"))
    listed = askers.join(best, "query").select(
        "query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best")
    )
    return listed.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")
    )


def op12_neighbours(spark, sf_dir: str) -> DataFrame:
    """The nearest rows of every row of ``embeddings`` whose id is divisible by 20, among all others."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
