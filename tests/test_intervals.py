"""Choice of a threshold and bootstrap limits against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlova.operators import classify, evaluate


def wilson(hits, n, z):
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


@pytest.mark.parametrize("target", [0.5, 0.7, 0.99])
def test_chosen_threshold_is_the_lowest_that_is_proven(spark, target):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        c = rng.random()
        rows.append((i, "A" if rng.random() < c else "B", c, "A"))
    pred = spark.createDataFrame([*rows, (999, "A", None, "A")], "qid bigint, intent string, confidence double, true_intent string")
    want = None
    for t in range(101):
        kept = [r for r in rows if math.floor(round(r[2] * 100, 9)) >= t]
        if kept and wilson(sum(r[1] == r[3] for r in kept), len(kept), 1.645) >= target:
            want = (t / 100, len(kept))
            break
    got = classify.chosen_threshold(pred, target, 100).collect()
    assert len(got) == 1
    assert (got[0].threshold, got[0].n_kept) == (want or (None, None))
    assert classify.choose_threshold(pred, target, 100) == (want[0] if want else 2.0)
    assert (want is None) == (target == 0.99)
    assert classify.choose_threshold(pred.limit(0), target) == 2.0


def test_weights_are_poisson_and_do_not_depend_on_the_partitioning(spark):
    rows = spark.range(4000).withColumn("w", evaluate.poisson_weight(F.col("id"), F.lit(3)))
    got = {r.id: r.w for r in rows.collect()}
    assert got == {r.id: r.w for r in rows.repartition(7).collect()}
    assert abs(np.mean(list(got.values())) - 1) < 0.06 and abs(np.var(list(got.values())) - 1) < 0.12
    for i in range(50):
        u = int(hashlib.md5(f"{i}#3".encode()).hexdigest()[:8], 16) / 2**32
        total, k = math.exp(-1), 0
        while u >= total and k < 9:
            k += 1
            total += math.exp(-1) / math.factorial(k)
        assert got[i] == k


def test_metric_intervals_match_a_plain_bootstrap(spark):
    rng = random.Random(4)
    rows = [(f"e{i}", s, rng.choice("XYZ"), rng.choice("XXYZ")) for i in range(60) for s in ("one", "two")]
    pred = spark.createDataFrame(rows, "example_id string, system string, t string, p string")
    got = {(r.system, r.metric): r for r in evaluate.metric_intervals(pred, "example_id", "t", "p", ["system"], 40, 0.9).collect()}
    assert len(got) == 6

    def weight(i, rep):
        u = int(hashlib.md5(f"{i}#{rep}".encode()).hexdigest()[:8], 16) / 2**32
        return sum(u >= s for s in evaluate.POISSON_STEPS)

    for system in ("one", "two"):
        values = {"accuracy": [], "macro_f1": []}
        for rep in range(1, 41):
            drawn = [(t, p, weight(i, rep)) for i, s, t, p in rows if s == system and weight(i, rep)]
            total = sum(w for *_, w in drawn)
            values["accuracy"].append(sum(w for t, p, w in drawn if t == p) / total)
            f1 = []
            for label in {t for t, _, _ in drawn} | {p for _, p, _ in drawn}:
                tp = sum(w for t, p, w in drawn if t == p == label)
                f1.append(2 * tp / sum(w * ((t == label) + (p == label)) for t, p, w in drawn))
            values["macro_f1"].append(np.mean(f1))
        for metric, found in values.items():
            row = got[system, metric]
            assert abs(row.low - np.quantile(found, 0.05)) < 1e-9 and abs(row.high - np.quantile(found, 0.95)) < 1e-9
            assert row.low <= row.value <= row.high
