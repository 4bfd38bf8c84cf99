"""k-means from many starts: costs against separate fits, a plain version, edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from parlova.operators import kmeans


def _blobs(spark, centers=5, per=40, dims=6):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(centers, dims)) * 20
    rows = [(i * per + j, (middle[i] + rng.normal(size=dims)).tolist()) for i in range(centers) for j in range(per)]
    return spark.createDataFrame(rows, "vec_id bigint, vec array<double>")


def test_cost_not_above_separate_fits(spark):
    rows = _blobs(spark)
    fit = kmeans.fit_kmeans(rows, 5, n_init=10)
    data = rows.select(array_to_vector("vec").alias("features"))
    best = min(KMeans(k=5, seed=s).fit(data).summary.trainingCost for s in range(42, 52))
    assert fit.cost <= best * (1 + 1e-9)
    assert len(fit.costs) == 10 and fit.cost == min(fit.costs)


def test_cost_and_labels_against_a_plain_version(spark):
    rows = _blobs(spark, 3)
    fit = kmeans.fit_kmeans(rows, 3, n_init=2)
    pdf = kmeans.assign_kmeans(rows, fit).toPandas()
    x = np.stack(pdf["vec"])
    squared = ((x[:, None, :] - fit.centers[None]) ** 2).sum(2)
    assert (squared.argmin(1) == pdf["cluster"].to_numpy()).all()
    assert np.isclose(squared.min(1).sum(), fit.cost)
    for c in range(3):
        assert np.allclose(x[pdf["cluster"] == c].mean(0), fit.centers[c], atol=1e-3)


def test_sparse_equals_dense(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 12)) * (rng.random((60, 12)) < 0.3)
    x[7] = 0.0
    dense = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, vec array<double>")
    rows = [(i, Vectors.sparse(12, {int(j): float(v[j]) for j in np.flatnonzero(v)})) for i, v in enumerate(x)]
    sparse = spark.createDataFrame(rows, ["vec_id", "features"])
    mixed = spark.createDataFrame([(i, v if i % 2 else Vectors.dense(v.toArray())) for i, v in rows], ["vec_id", "features"])
    fits = [kmeans.fit_kmeans(t, 4, n_init=3) for t in (dense, sparse, mixed)]
    for other, table in zip(fits[1:], (sparse, mixed)):
        assert np.allclose(fits[0].centers, other.centers) and np.isclose(fits[0].cost, other.cost)
        mine = {r.vec_id: r.cluster for r in kmeans.assign_kmeans(dense, fits[0]).collect()}
        assert mine == {r.vec_id: r.cluster for r in kmeans.assign_kmeans(table, other).collect()}


def test_one_scan_a_round_for_all_starts(spark, monkeypatch):
    rows = _blobs(spark, 4)
    calls = []
    real = kmeans._round
    monkeypatch.setattr(kmeans, "_round", lambda data, centers: calls.append(len(centers)) or real(data, centers))
    fit = kmeans.fit_kmeans(rows, 4, n_init=6)
    assert len(calls) == fit.rounds + 1 and calls[0] == calls[-1] == 6
    assert calls[:-1] == sorted(calls[:-1], reverse=True)


def test_reruns_and_partitions_agree(spark):
    rows = _blobs(spark)
    fits = [kmeans.fit_kmeans(rows.repartition(n), 5, n_init=4) for n in (1, 7)]
    assert fits[0].seed == fits[1].seed and np.allclose(fits[0].centers, fits[1].centers)


def test_copies_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)] + [(30, None)], "vec_id bigint, vec array<double>")
    fit = kmeans.fit_kmeans(rows, 3, n_init=2)
    assert fit.cost == pytest.approx(0.0) and np.allclose(fit.centers, [1.0, 2.0])
    found = kmeans.assign_kmeans(rows, fit).groupBy("cluster").agg(F.count("*").alias("n")).collect()
    assert {(r.cluster, r.n) for r in found} == {(0, 30), (None, 1)}
    with pytest.raises(ValueError):
        kmeans.fit_kmeans(rows.limit(0), 3)


def test_bounded_steps(spark, monkeypatch):
    rows = kmeans._Rows(np.array([0, 3, 3, 10, 11]), None, np.arange(11.0))
    monkeypatch.setattr(kmeans, "STEP_VALUES", 4)
    assert [(a, b, len(p.val)) for a, b, p in rows.steps()] == [(0, 2, 3), (2, 3, 7), (3, 4, 1)]
