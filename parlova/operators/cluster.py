"""Clusters of vectors: fit, centroids, assignment, representatives, silhouette.

Vector tables have (vec_id, vec ARRAY<DOUBLE>) and, once labelled, a cluster column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlova.functions.arrays import distance, dot, squared_distance
from parlova.functions.text import ngrams
from parlova.operators.classify import fit_text_features
from parlova.operators.grid import CELL_SCORES, Postings, few_blocks, flat, triangle_apply
from parlova.operators.kmeans import KMeansFit, assign_kmeans, cluster_count, fit_kmeans  # noqa: F401
from parlova.operators.ranking import top_k
from parlova.runtime import materialize

SILHOUETTE_BLOCK = 1024
SILHOUETTE_BLOCKS = 12


def centroids(labelled: DataFrame, label_col: str) -> DataFrame:
    """Mean vector per label as (label, pos, mean); partial sums precede the shuffle."""
    return (
        labelled.where(F.col(label_col).isNotNull())
        .select(F.col(label_col).alias("label"), F.posexplode("vec").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg("x").alias("mean"))
    )


def centroid_vectors(centroid_rows: DataFrame) -> DataFrame:
    """(label, centroid ARRAY<DOUBLE>); one row per label."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "mean")))
    return centroid_rows.groupBy("label").agg(F.transform(parts, lambda p: p["mean"]).alias("centroid"))


def _with_small_table(df: DataFrame, name: str, rows: DataFrame, *cols: str) -> DataFrame:
    """Add a per-label table as one ARRAY<STRUCT> column (labels x dimensions numbers)."""
    one = rows.agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("all"))
    return df.withColumn(name, one.select("all").scalar())


def nearest_centroid(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """Add ``predicted``: the label of the nearest of ``centers`` (label, centroid).

    Ties go to the smaller label.
    """
    choices = F.transform(
        "_centers",
        lambda c: F.struct(
            F.round(squared_distance(F.col("vec"), c["centroid"]), 9).alias("d"), c["label"].alias("label")
        ),
    )
    beside = _with_small_table(vectors, "_centers", centers, "label", "centroid")
    return beside.withColumn("predicted", F.array_min(choices)["label"]).drop("_centers")


def cluster_representatives(labelled: DataFrame, label_col: str, n: int = 5) -> DataFrame:
    """The ``n`` members nearest to each centroid: (label, rank, vec_id)."""
    centers = F.broadcast(centroid_vectors(centroids(labelled, label_col)))
    near = labelled.withColumnRenamed(label_col, "label").join(centers, "label").select(
        "label", "vec_id", distance(F.col("vec"), F.col("centroid")).alias("dist")
    )
    order = [F.round("dist", 9), F.col("vec_id")]
    return top_k(near, ["label"], order, n).select("label", "rank", "vec_id")


def _silhouette_of(own_sum: Column, own_n: Column, other: Column) -> Column:
    a = own_sum / F.greatest(own_n - 1, F.lit(1))
    value = F.try_divide(other - a, F.greatest(a, other))
    return F.when(own_n <= 1, 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def _mean_silhouette(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """``sums`` (vec_id, label, cluster, total): summed distance of a point to a cluster."""
    per_point = (
        sums.join(F.broadcast(sizes), "cluster")
        .groupBy("vec_id", "label")
        .agg(
            F.max(F.when(F.col("cluster") == F.col("label"), F.col("total"))).alias("own"),
            F.max(F.when(F.col("cluster") == F.col("label"), F.col("size"))).alias("own_n"),
            F.min(F.when(F.col("cluster") != F.col("label"), F.col("total") / F.col("size"))).alias("other"),
        )
    )
    s = _silhouette_of(F.col("own"), F.col("own_n"), F.col("other"))
    # A single cluster leaves no other one: the score is then 0.
    return per_point.agg(F.coalesce(F.avg(F.when(F.col("other").isNotNull(), s)), F.lit(0.0)).alias("silhouette"))


class _Block:
    """Vectors of a block, dense or sparse, with their clusters and ids."""

    def __init__(self, rows: pa.Table):
        value, bounds = flat(rows["vec"])
        self.value = value.to_numpy(zero_copy_only=False).astype(float)
        self.bounds, self.n = bounds, rows.num_rows
        self.place = flat(rows["idx"])[0].to_numpy(zero_copy_only=False).astype(np.int64) if "idx" in rows.column_names else None
        if self.place is None:
            self.value = self.value.reshape(self.n, -1)
            self.square = (self.value * self.value).sum(1)
        else:
            owner = np.repeat(np.arange(self.n), np.diff(bounds))
            self.square = np.bincount(owner, self.value * self.value, self.n)
        label = rows["label"].combine_chunks()
        self.clusters = label.unique().drop_null()
        member = pc.fill_null(pc.index_in(label, value_set=self.clusters), -1).to_numpy(zero_copy_only=False)
        self.member = (member[:, None] == np.arange(len(self.clusters))[None, :]).astype(float)
        self.rows = rows

    def dims(self) -> int:
        return int(self.place.max(initial=-1)) + 1

    def postings(self, dims: int) -> Postings:
        return Postings.of(self.place, self.bounds, self.value, dims)

    def totals(self, sums: np.ndarray, clusters: pa.Array) -> pa.Table:
        """One row per point and cluster of the other block."""
        each, own = np.repeat(np.arange(self.n), len(clusters)), np.tile(np.arange(len(clusters)), self.n)
        found = {c: self.rows[c].take(pa.array(each)) for c in ("vec_id", "label")}
        return pa.table({**found, "cluster": clusters.take(pa.array(own)), "total": pa.array(sums.ravel())})


def _pair_sums(a: pa.Table, b: pa.Table) -> pa.Table:
    """Summed distances of the points of two blocks to each other's clusters; of a block to its own ones."""
    same = a["_lb"][0] == a["_rb"][0]
    x = _Block(a)
    y = x if same else _Block(b)
    sparse = x.place is not None
    postings = y.postings(max(x.dims(), y.dims())) if sparse else None
    ids = a["vec_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    to_y, to_x = np.zeros((x.n, len(y.clusters))), np.zeros((y.n, len(x.clusters)))
    step = max(1, CELL_SCORES // y.n)
    for low in range(0, x.n, step):
        high = min(x.n, low + step)
        if sparse:
            spans = [slice(x.bounds[i], x.bounds[i + 1]) for i in range(low, high)]
            dist = np.stack([postings.dot(x.place[r], x.value[r]) for r in spans])
        else:
            dist = x.value[low:high] @ y.value.T
        dist *= -2.0
        dist += x.square[low:high, None]
        dist += y.square[None, :]
        np.maximum(dist, 0.0, out=dist)
        np.sqrt(dist, out=dist)
        if same:
            # Rounding noise must not give a point a distance to itself.
            dist[ids[low:high, None] == ids[None, :]] = 0.0
        to_y[low:high] = dist @ y.member
        if not same:
            to_x += dist.T @ x.member[low:high]
    if same:
        return x.totals(to_y, y.clusters)
    return pa.concat_tables([x.totals(to_y, y.clusters), y.totals(to_x, x.clusters)])


def silhouette_exact(labelled: DataFrame, label_col: str, block: int = SILHOUETTE_BLOCK) -> DataFrame:
    """Mean Euclidean silhouette over all points.

    The definition needs every distance. Every two blocks of points meet once and return one sum per
    (point, cluster), never pairs. Tables of more than ``block`` rows are cut into SILHOUETTE_BLOCKS
    blocks, more only where one would pass the bounds of a cell, so points are sent as
    often however many there are. For very large tables use ``silhouette_fast``, linear in the points.
    Rows are ``vec`` arrays, or the values ``vec`` at the positions ``idx``.
    """
    parts = ["vec", "idx"] if "idx" in labelled.columns else ["vec"]
    points = labelled.select("vec_id", F.col(label_col).alias("label"), *parts)
    rows, values = points.agg(F.count(F.lit(1)), F.sum(F.size("vec"))).first()
    n = few_blocks(rows, values or 0, block, SILHOUETTE_BLOCKS)
    kind = points.schema["label"].dataType.simpleString()
    id_kind = points.schema["vec_id"].dataType.simpleString()

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            return _pair_sums(a, b)
        return pa.table({"vec_id": a["vec_id"][:0], "label": a["label"][:0], "cluster": b["label"][:0], "total": pa.array([], pa.float64())})

    cells = triangle_apply(points, "vec_id", n, cell, f"vec_id {id_kind}, label {kind}, cluster {kind}, total double")
    sums = cells.groupBy("vec_id", "label", "cluster").agg(F.sum("total").alias("total"))
    sizes = points.groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    return _mean_silhouette(sums, sizes)


def silhouette_fast(labelled: DataFrame, label_col: str) -> DataFrame:
    """Mean squared-Euclidean silhouette, from per-cluster sums only.

    sum over y of |x-y|^2 = n|x|^2 + sum|y|^2 - 2 x·sum y, so one pass for the
    cluster sums and one over the points suffice.
    """
    points = labelled.select("vec_id", F.col(label_col).alias("label"), "vec")
    sums = (
        points.select("label", F.posexplode("vec").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.sum("x").alias("mean"), F.sum(F.col("x") * F.col("x")).alias("sq"), F.count(F.lit(1)).alias("size"))
    )
    stats = sums.groupBy(F.col("label").alias("cluster")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda p: p["mean"]).alias("total_vec"),
        F.sum("sq").alias("total_sq"),
        F.max("size").alias("size"),
    )
    vec = F.col("vec")
    points = _with_small_table(points, "_stats", stats, "cluster", "size", "total_sq", "total_vec")
    per_cluster = F.transform(
        "_stats",
        lambda c: F.struct(
            c["cluster"].alias("cluster"),
            (c["size"] * dot(vec, vec) + c["total_sq"] - 2.0 * dot(vec, c["total_vec"])).alias("total"),
        ),
    )
    long = points.select("vec_id", "label", F.inline(per_cluster))
    return _mean_silhouette(long, stats.select("cluster", "size"))


# --- discovery ------------------------------------------------------------------


@dataclass(frozen=True)
class Discovery:
    """Clusters of texts: assignment, nearest members, and the quality of the split."""

    assigned: DataFrame  # (vec_id, text, cluster)
    representatives: DataFrame  # (cluster, rank, vec_id, text)
    silhouette: DataFrame  # one row
    fit: KMeansFit


def discover_text_clusters(
    docs: DataFrame,
    wanted: int = 8,
    n_init: int = 10,
    seed: int = 42,
    n_examples: int = 5,
    max_features: int = 5000,
    min_df: int = 2,
) -> Discovery:
    """Cluster (vec_id, text) by TF-IDF of words and word pairs; vectors stay sparse."""
    grams = docs.withColumn("grams", ngrams(F.col("text")))
    vectors = materialize(
        fit_text_features(grams, max_features, min_df).transform(grams).select("vec_id", "text", "features")
    )
    fit = fit_kmeans(vectors, wanted, n_init, seed)
    raw = F.unwrap_udt("features")
    assigned = materialize(
        assign_kmeans(vectors, fit).select(
            "vec_id", "text", "cluster", raw["values"].alias("vec"), raw["indices"].alias("idx")
        )
    )
    # Clusters x vocabulary numbers: the model itself, one broadcast row per cluster.
    centers = docs.sparkSession.createDataFrame(
        [(i, c.tolist(), float(c @ c)) for i, c in enumerate(fit.centers)],
        "cluster int, center array<double>, center_sq double",
    )
    shared = F.zip_with("idx", "vec", lambda i, v: v * F.element_at("center", i + 1))
    cross = F.aggregate(shared, F.lit(0.0), lambda s, x: s + x)
    squared = dot(F.col("vec"), F.col("vec")) - 2.0 * cross + F.col("center_sq")
    near = assigned.join(F.broadcast(centers), "cluster").withColumn("dist", F.round(squared, 9))
    closest = top_k(near, ["cluster"], [F.col("dist"), F.col("vec_id")], n_examples)
    return Discovery(
        assigned.select("vec_id", "text", "cluster"),
        closest.select("cluster", "rank", "vec_id", "text"),
        silhouette_exact(assigned, "cluster"),
        fit,
    )
