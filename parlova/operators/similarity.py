"""Exact top-k similarity over sparse features and dense vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlova.functions.arrays import cosine
from parlova.functions.text import clip01
from parlova.operators.dense_cells import BLOCK_QUERIES, BLOCK_ROWS, ring_topk
from parlova.operators.frames import union_all
from parlova.operators.grid import (
    MAX_VALUES,
    Cell,
    best_in_cell,
    block_count,
    by_id,
    cheap_blocks,
    grid_apply,
    meeting,
    pairs_cell,
    sparse_cell,
    unit_matrix,
    waves,
)
from parlova.operators.ranking import top_k
from parlova.operators.skew import hot_keys, lookup_join
from parlova.runtime import materialize, scratch_scope

# Postings a query may read in the first round; tenfold in each next one.
HEAVY_DF = 10_000
# A plain join where no query has more than as many times HEAVY_DF postings ...
PLAIN = 10
# ... and all queries together no more than this; the same for a round. More would fill the disks with scored pairs.
PAIRS = 5_000_000
BLOCK_POSTINGS = 1_024
# Slack for rounding when a bound is compared with a score.
MARGIN = 1e-9
QUERY_BLOCK = 1024
DOC_BLOCK = 2048
# Cells of the grid as long as no block passes the bounds: rows are sent in proportion to the root of their number, and
# a wave sends the less the more there are.
CELLS = 64
# Pairs whose vectors are held at once to be scored in double precision.
_EXACT_ROWS = 1 << 16
# Postings of the documents are shuffled into lists in so many turns.
PACKED_PARTS = 4


def best_first():
    """Score first (rounded, so that summation order cannot decide), then doc id."""
    return [F.round(F.col("score"), 9).desc(), F.col("doc_id")]


def _positive() -> Column:
    """A score counts if it is above 0 at the digits that ranks are taken from."""
    return F.round(F.col("score"), 9) > 0


def sparse_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    heavy_df: int = HEAVY_DF,
    parts: dict[str, str] | None = None,
    query_block: int = QUERY_BLOCK,
    doc_block: int = DOC_BLOCK,
    block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """The ``k`` documents with the highest positive sum of qw·w per query, exactly.

    ``queries`` (qid, feature, qw), ``docs`` (feature, doc_id, w, df), all weights
    positive, each (id, feature) once, ``df`` the rows of the feature in ``docs``.
    Pass a stored ``docs``: it is read several times. ``parts`` (column -> feature
    prefix, together covering all features) adds the share of the score each earns.

    Where no query has more than PLAIN * ``heavy_df`` postings (rows of its features), nor all together more than
    PAIRS, a plain join scores them all. Else, as long as a round reads no more than PAIRS postings, postings lie in
    blocks by impact (see ``impact_blocks``), and a query reads the blocks of largest gain, ``heavy_df`` postings at
    first (see ``_bounded_round``). Queries whose result is not yet proven final read ten times as many, and so on.
    Many queries, and those that would read more postings than there are documents, meet blocks of whole documents in
    grid cells that return their k best: their pairs are never stored. The cells run in waves (see ``grid.waves``).

    The result is stored, as most callers read it more than once; the tables made on the way are gone.
    """
    with scratch_scope(queries.sparkSession) as keep:
        return keep(_best_rows(queries, docs, k, heavy_df, parts or {}, query_block, doc_block, block_postings))


def _best_rows(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    heavy_df: int,
    parts: dict[str, str],
    query_block: int,
    doc_block: int,
    block_postings: int,
) -> DataFrame:
    earned = F.col("qw") * F.col("w")
    gains = {"score": earned} | {
        name: F.when(F.startswith(F.col("feature"), F.lit(prefix)), earned).otherwise(0.0)
        for name, prefix in parts.items()
    }
    queries = materialize(queries)
    if reads_few([(queries, docs)], PLAIN * heavy_df):
        scored = (
            queries.join(docs.drop("df"), "feature")
            .groupBy("qid", "doc_id")
            .agg(*[F.sum(g).alias(name) for name, g in gains.items()])
        )
        return top_k(scored.where(_positive()), ["qid"], best_first(), k)

    # Only sizes the work, so an estimate without a shuffle will do.
    n_docs = docs.agg(F.approx_count_distinct("doc_id")).first()[0]
    columns = ["qid", "doc_id", *gains, "rank"]
    done: list[DataFrame] = []
    allowance, open_q = heavy_df, queries
    n_open = open_q.select("qid").distinct().count()
    if n_open * allowance <= PAIRS:
        impacts = impact_blocks(docs, block_postings)
        features = impacts.blocks.select("feature").distinct()
        open_q = materialize(queries.join(features, "feature", "left_semi"))
        n_open = open_q.select("qid").distinct().count()
    while n_open and allowance <= n_docs and n_open * allowance <= PAIRS:
        found, settled = _bounded_round(open_q, impacts, k, allowance, gains)
        done.append(found.join(settled, "qid", "left_semi").select(*columns))
        open_q = materialize(open_q.join(settled, "qid", "left_anti").select(*open_q.columns))
        n_open = open_q.select("qid").distinct().count()
        allowance = max(1, allowance) * 10
    if done and n_open == 0:
        return union_all(done)
    left, right = _packed(open_q, "qid", "qw"), _packed(docs, "doc_id", "w", PACKED_PARTS)
    n_left, n_right = cheap_blocks(_sizes(left), _sizes(right), query_block, doc_block, CELLS, len(gains) * k)
    cell, schema = sparse_cell(k, parts), _cell_schema(queries, docs, list(parts))
    best = []
    for blocks in waves(n_left, n_right):
        rows = grid_apply(left, right, "qid", "doc_id", n_left, n_right, cell, schema, *blocks)
        best.append(materialize(top_k(rows, ["qid"], best_first(), k).drop("rank")))
    # A query meets the documents in several waves.
    done.append(top_k(union_all(best), ["qid"], best_first(), k).select(*columns))
    return union_all(done)


def sparse_pairs(queries: DataFrame, docs: DataFrame, query_block: int = QUERY_BLOCK, doc_block: int = DOC_BLOCK) -> DataFrame:
    """The sum of qw·w, above 0, of every (qid, doc_id); tables as in ``sparse_topk``.

    The rows are as many as the pairs that share a feature, so blocks of both sides meet in cells that return no more
    than ``query_block`` x ``doc_block`` rows: neither postings nor pairs are shuffled.
    """
    left, right = _packed(queries, "qid", "qw"), _packed(docs, "doc_id", "w")
    blocks = [
        max(block_count(rows, block), block_count(values, MAX_VALUES))
        for (rows, values), block in [(_sizes(left), query_block), (_sizes(right), doc_block)]
    ]
    return grid_apply(left, right, "qid", "doc_id", *blocks, pairs_cell, _cell_schema(queries, docs))


def _packed(rows: DataFrame, key: str, weight: str, n_parts: int = 1) -> DataFrame:
    """One stored row per key, with lists of its features and their weights; keys are packed in ``n_parts`` turns."""
    known = rows.where(F.col("feature").isNotNull())
    turns = [known.where(F.pmod(F.xxhash64(key), F.lit(n_parts)) == i) for i in range(n_parts)] if n_parts > 1 else [known]
    lists = [t.groupBy(key).agg(F.collect_list(F.struct("feature", weight)).alias("_f")) for t in turns]
    return materialize(*[p.select(key, F.col("_f.feature").alias("feature"), F.col(f"_f.{weight}").alias(weight)) for p in lists])


def _sizes(packed: DataFrame) -> tuple[int, int]:
    """Rows, and numbers in their lists."""
    rows, values = packed.agg(F.count(F.lit(1)), F.sum(F.size("feature"))).first()
    return rows, values or 0


def count_postings(queries: DataFrame, docs: DataFrame) -> tuple[int, int]:
    """The rows of ``docs`` that the features of one query have together: the most of any, and the sum of all."""
    sizes = docs.groupBy("feature").agg(F.max("df").alias("df"))
    total = queries.select("qid", "feature").join(sizes, "feature").groupBy("qid").agg(F.sum("df").alias("n"))
    most, everything = total.agg(F.max("n"), F.sum("n")).first()
    return most or 0, everything or 0


def reads_few(parts: list[tuple[DataFrame, DataFrame]], limit: int) -> bool:
    """Whether no query has more than ``limit`` postings in all (queries, docs) together, nor all queries more than PAIRS.

    Few postings tell it at once.
    """
    held, asked = sum(docs.count() for _, docs in parts), sum(queries.count() for queries, _ in parts)
    if held <= limit and held * asked <= PAIRS:
        return True
    most, everything = (sum(n) for n in zip(*[count_postings(queries, docs) for queries, docs in parts]))
    return most <= limit and everything <= PAIRS


@dataclass(frozen=True)
class Impacts:
    """Postings in blocks by impact.

    ``rows`` (feature, doc_id, w, level, chunk); ``blocks`` (feature, level, n, max_w, chunks).
    """

    rows: DataFrame
    blocks: DataFrame
    block_postings: int


def impact_blocks(docs: DataFrame, block_postings: int = BLOCK_POSTINGS) -> Impacts:
    """The postings of each feature by levels of weight, two per octave, with the largest weight of each.

    A level follows from the weight alone, so nothing is sorted. A level of more than ``block_postings`` rows is cut
    by document into chunks of about as many, which share its largest weight.
    """
    level = F.greatest(F.lit(-80), F.least(F.lit(80), F.floor(F.log2("w") * -2))).cast("int")
    rows = docs.select("feature", "doc_id", "w", level.alias("level"))
    blocks = rows.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("max_w"))
    blocks = materialize(blocks.withColumn("chunks", F.ceil(F.col("n") / block_postings).cast("int")))
    cut = blocks.where("chunks > 1").select("feature", "level", "chunks")
    chunk = F.pmod(F.xxhash64("doc_id"), F.coalesce("chunks", F.lit(1))).cast("int")
    rows = rows.join(cut, ["feature", "level"], "left").withColumn("chunk", chunk).drop("chunks")
    return Impacts(materialize(rows), blocks, block_postings)


def _bounded_round(
    q: DataFrame, impacts: Impacts, k: int, allowance: int, gains: dict[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """(best k found per query, queries for which they are final).

    A query reads its blocks in the order of their largest gain, qw * max(w), until ``allowance`` postings. What a
    document can earn from the blocks that are left is at most the sum over features of the largest gain
    left. Candidates that cannot reach the k-th score with that much more drop out, the others' scores are
    completed from the unread blocks by (doc, feature) lookups. A query is final when the sum is below its
    k-th score, as no unseen document can beat it, or when no block is left.
    """
    measures = list(gains)
    gain = F.col("qw") * F.col("max_w")
    largest_first = Window.partitionBy("qid").orderBy(gain.desc(), "feature", "level")
    room = F.lit(allowance) - F.coalesce(F.sum("n").over(largest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = q.join(impacts.blocks, "feature").withColumn("room", room)
    taken = F.when(F.col("room") >= F.col("n"), F.col("chunks")).otherwise(
        F.greatest(F.lit(0), F.floor(F.col("room") / impacts.block_postings)).cast("int")
    )
    plan = materialize(plan.withColumn("taken", taken).drop("room", "n"))
    reads = plan.where("taken > 0").select(
        "qid", "feature", "qw", "level", F.explode(F.sequence(F.lit(0), F.col("taken") - 1)).alias("chunk")
    )
    light = materialize(
        reads.join(impacts.rows, ["feature", "level", "chunk"])
        .groupBy("qid", "doc_id")
        .agg(*[F.sum(g).alias(name) for name, g in gains.items()])
    )
    # Per query and feature, what was taken of each level, and the largest gain left.
    left = plan.groupBy("qid", "feature").agg(
        F.first("qw").alias("qw"),
        F.max(F.when(F.col("taken") < F.col("chunks"), gain)).alias("left"),
        F.map_from_entries(F.collect_list(F.struct("level", "taken"))).alias("read"),
    )
    left = materialize(left)
    per_query = left.groupBy("qid").agg(F.sum(F.coalesce("left", F.lit(0.0))).alias("bound"))
    kth = (
        top_k(light, ["qid"], best_first(), k)
        .groupBy("qid")
        .agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
    )
    # These scores are lower bounds, so what cannot reach the k-th one drops out.
    reachable = F.col("kth").isNull() | (F.col("score") + F.col("bound") >= F.col("kth") - MARGIN)
    candidates = (
        light.join(per_query, "qid").join(kth, "qid", "left").where(reachable).select("qid", "doc_id", *measures)
    )
    completion = (
        candidates.select("qid", "doc_id")
        .join(left.where("left IS NOT NULL").select("qid", "feature", "qw", "read"), "qid")
        .join(impacts.rows, ["doc_id", "feature"])
        .where(F.col("chunk") >= F.element_at("read", F.col("level")))
        .select("qid", "doc_id", *[g.alias(name) for name, g in gains.items()])
    )
    complete = (
        candidates.unionByName(completion).groupBy("qid", "doc_id").agg(*[F.sum(m).alias(m) for m in measures])
    )
    found = materialize(top_k(complete.where(_positive()), ["qid"], best_first(), k))
    proven = (F.col("bound") == 0) | ((F.col("n") == k) & (F.col("bound") < F.col("kth") - MARGIN))
    settled = (
        per_query.join(found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")), "qid", "left")
        .where(F.coalesce(proven, F.lit(False)))
        .select("qid")
    )
    return found, materialize(settled)


def _cell_schema(queries: DataFrame, docs: DataFrame, parts: list[str] | None = None) -> str:
    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *docs.schema]}
    extra = "".join(f", {p} double" for p in parts or [])
    return f"qid {kind['qid']}, doc_id {kind['doc_id']}, score double{extra}"


def score_pairs(pairs: DataFrame, queries: DataFrame, docs: DataFrame, out: str) -> DataFrame:
    """Add column ``out``: the sum of qw·w of each given (qid, doc_id), 0 without a match."""
    sums = (
        pairs.select("qid", "doc_id")
        .join(queries, "qid")
        .join(docs.select("feature", "doc_id", "w"), ["doc_id", "feature"])
        .groupBy("qid", "doc_id")
        .agg(F.sum(F.col("qw") * F.col("w")).alias(out))
    )
    return pairs.join(sums, ["qid", "doc_id"], "left").na.fill(0.0, [out])


def pad_topk(hits: DataFrame, query_ids: DataFrame, doc_ids: DataFrame, k: int) -> DataFrame:
    """Fill queries with fewer than ``k`` hits with zero scores, smallest doc ids first."""
    smallest = [r[0] for r in doc_ids.select("doc_id").orderBy("doc_id").limit(k).collect()]
    if not smallest:
        return hits
    pads = F.array(*[F.lit(i) for i in smallest])
    have = hits.groupBy("qid").agg(F.collect_list("doc_id").alias("have"), F.count(F.lit(1)).alias("n"))
    none = F.array().cast(f"array<{doc_ids.schema['doc_id'].dataType.simpleString()}>")
    free = F.slice(F.array_except(pads, F.coalesce("have", none)), 1, F.lit(k) - F.coalesce("n", F.lit(0)).cast("int"))
    filled = (
        query_ids.select("qid")
        .join(have, "qid", "left")
        .where(F.coalesce("n", F.lit(0)) < k)
        .select("qid", F.coalesce("n", F.lit(0)).alias("n"), F.posexplode(free).alias("pos", "doc_id"))
        .select("qid", "doc_id", F.lit(0.0).alias("score"), (F.col("n") + F.col("pos") + 1).alias("rank"))
    )
    # Parts of a score, if any, are zero as well.
    extra = [c for c in hits.columns if c not in filled.columns]
    return hits.select("qid", "doc_id", "score", "rank", *extra).unionByName(
        filled.withColumns({c: F.lit(0.0) for c in extra})
    )


def dense_topk(
    queries: DataFrame, docs: DataFrame, k: int, query_block: int = BLOCK_QUERIES, doc_block: int = BLOCK_ROWS
) -> DataFrame:
    """Top-k by cosine clipped to [0, 1]; ``queries`` (qid, vec), ``docs`` (doc_id, vec).

    Only positive scores are returned; ``pad_topk`` adds the zero ones. Cells of documents that cannot
    reach a query's k-th score are skipped (see ``dense_cells``).
    """
    asked = queries.select("qid", "vec", F.lit(0.0).alias("_most"))
    return ring_topk(
        asked, docs.select("doc_id", "vec"), k, _dense_cell(k), _cell_schema(queries, docs), best_first(), 1.0, doc_block, query_block
    )


def _dense_cell(k: int) -> Cell:
    """Cosines in single precision tell which pairs may count; these are scored in double precision."""

    def cell(q: pa.Table, d: pa.Table) -> pa.Table:
        d = by_id(d)
        asked, held = unit_matrix(q["vec"]), unit_matrix(d["vec"])
        # Zero vectors have no positive score.
        rows, places = np.flatnonzero(asked.any(axis=1)), np.flatnonzero(held.any(axis=1))
        asked, held = asked[rows], held[places]
        rough, rough_held = asked.astype(np.float32), np.ascontiguousarray(held.T, np.float32)
        slack = (held.shape[1] + 4) * float(np.finfo(np.float32).eps)

        def exact(row: np.ndarray, place: np.ndarray) -> np.ndarray:
            parts = range(0, len(row), _EXACT_ROWS)
            each = [np.einsum("ij,ij->i", asked[row[p : p + _EXACT_ROWS]], held[place[p : p + _EXACT_ROWS]]) for p in parts]
            return np.clip(np.concatenate([np.zeros(0), *each]), 0.0, 1.0)

        best = best_in_cell(q.take(pa.array(rows)), d.take(pa.array(places)), k, lambda part: rough[part] @ rough_held, exact, slack)
        return best.set_column(best.num_columns - 1, "_row", pa.array(rows[best["_row"].to_numpy()]))

    return cell


def fused_topk(
    queries: DataFrame,
    docs: DataFrame,
    sparse_q: DataFrame,
    sparse_d: DataFrame,
    k: int,
    dense_weight: float,
    query_block: int = BLOCK_QUERIES,
    doc_block: int = BLOCK_ROWS,
) -> DataFrame:
    """Top-k by dense_weight * cosine + sum qw*w, both parts scored where documents lie.

    The sparse part of a query is at most the sum of qw * max(w) of its features; with the bound of the
    cosine this tells which cells it can skip.
    """

    def packed(ids: DataFrame, key: str, rows: DataFrame, weight: str) -> DataFrame:
        lists = rows.where(F.col("feature").isNotNull()).groupBy(key).agg(F.collect_list(F.struct("feature", weight)).alias("_f"))
        return ids.join(lists, key, "left").select(*ids.columns, F.col("_f.feature").alias("feature"), F.col(f"_f.{weight}").alias(weight))

    best = sparse_d.groupBy("feature").agg(F.max("w").alias("max_w"))
    most = sparse_q.join(best, "feature").groupBy("qid").agg(F.sum(F.col("qw") * F.col("max_w")).alias("_most"))
    with scratch_scope(queries.sparkSession) as keep:
        left = packed(queries.select("qid", "vec"), "qid", sparse_q.select("qid", "feature", "qw"), "qw")
        left = left.join(most, "qid", "left").fillna(0.0, ["_most"])
        right = packed(docs.select("doc_id", "vec"), "doc_id", sparse_d.select("doc_id", "feature", "w"), "w")
        cell, schema = _fused_cell(k, dense_weight), _cell_schema(queries, docs)
        return keep(ring_topk(left, materialize(right), k, cell, schema, best_first(), dense_weight, doc_block, query_block))


def _fused_cell(k: int, dense_weight: float) -> Cell:
    def cell(q: pa.Table, d: pa.Table) -> pa.Table:
        d = by_id(d)
        asked, held = unit_matrix(q["vec"]), unit_matrix(d["vec"]).T.copy()
        codes, bounds, qw, _, postings = meeting(q, d)

        def scores(part: slice) -> np.ndarray:
            out = asked[part] @ held if held.size else np.zeros((len(asked[part]), d.num_rows))
            np.clip(out, 0.0, 1.0, out=out)
            out *= dense_weight
            for row, i in zip(out, range(part.start, part.start + len(out))):
                row += postings.dot(codes[bounds[i] : bounds[i + 1]], qw[bounds[i] : bounds[i + 1]])
            return out

        return best_in_cell(q, d, k, scores)

    return cell


def dense_pairs(pairs: DataFrame, queries: DataFrame, docs: DataFrame, out: str) -> DataFrame:
    """Add column ``out``: clipped cosine of each given (qid, doc_id)."""
    asked = materialize(pairs.join(queries.select("qid", F.col("vec").alias("_qv")), "qid"))
    vectors = docs.select("doc_id", F.col("vec").alias("_dv"))
    # Padded rows name the same few documents for many queries.
    joined = lookup_join(asked, vectors, "doc_id", "qid", hot_keys(asked, "doc_id"))
    return joined.withColumn(out, clip01(cosine(F.col("_qv"), F.col("_dv")))).drop("_qv", "_dv")
