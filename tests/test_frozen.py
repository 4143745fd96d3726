"""Stored metrics with planted faults, decisions out of fold with planted gaps, and logistic coefficients of raw features."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import frozen as fz
from evidra.operators import quality as qu

ROWS = [("base", 0, 0.5, 0.25, None), ("base", 1, 0.1, 1.0, float("nan")), (None, 2, 0.3, 0.2, 0.1)]
KIND = "condition string, seed int, f1 double, mcc double, auroc double"
LIMITS = {"f1": 1e-12, "mcc": 1e-6, "auroc": 1e-12}


def test_tolerance_tells_faults_apart(spark):
    a = spark.createDataFrame(ROWS, KIND)
    shift = lambda e: a.withColumn("f1", F.when(F.col("seed") == 0, F.col("f1") + e).otherwise(F.col("f1")))
    assert fz.require_reproduced(a, a, ["condition", "seed"], LIMITS) is a
    assert fz.cells(a, shift(1e-13), ["condition", "seed"], LIMITS).where("fault IS NOT NULL").count() == 0
    assert [(r.condition, r.seed, r.metric, r.fault) for r in fz.cells(a, shift(1e-11), ["condition", "seed"], LIMITS).where("fault IS NOT NULL").collect()] == [("base", 0, "f1", "differs")]
    with pytest.raises(ValueError, match=r"\{'differs': 1\}.*'base', 0, 'f1'"):
        fz.require_reproduced(a, shift(1e-11), ["condition", "seed"], LIMITS)


def test_faults_of_every_kind_are_listed(spark):
    a = spark.createDataFrame(ROWS, KIND)
    stored = spark.createDataFrame([("base", 0, 0.5, 0.25, 0.5), ("base", 1, 0.1, 1.1, None), ("base", 1, 0.1, 1.0, None), ("gone", 0, 0.0, 0.0, 0.0)], KIND)
    got = {(r.condition, r.seed, r.metric): r.fault for r in fz.cells(a, stored, ["condition", "seed"], LIMITS).collect()}
    want = {("base", 0, "f1"): None, ("base", 0, "mcc"): None, ("base", 0, "auroc"): "differs"}
    want |= {("base", 1, m): "ambiguous" for m in LIMITS} | {("gone", 0, m): "extra" for m in LIMITS} | {(None, 2, m): "missing" for m in LIMITS}
    assert got == want
    assert fz.cells(a.limit(0), stored.limit(0), ["condition", "seed"], LIMITS).count() == 0


KEYS = 60


def parts(spark):
    rows = spark.range(KEYS).select("id", (F.col("id") % 3).cast("int").alias("fold"), (F.pmod(F.col("id") * 7, F.lit(5)) < 2).cast("int").alias("label"), (F.pmod(F.col("id") * 37, F.lit(60)) / 60).alias("score"))
    return rows.withColumn("fold", F.pmod(F.col("fold") + 2, F.lit(3))), rows, rows.select("id")


def test_out_of_fold_equals_loop(spark):
    validation, test, expected = parts(spark)
    got = fz.out_of_fold(validation, test, expected, "fold", "id", "label", "score", 0.3).collect()
    assert sorted(r.id for r in got) == list(range(KEYS))
    held = {}
    for r in validation.collect():
        held.setdefault(r.fold, []).append((r.label, r.score))
    best = {}
    for fold, x in held.items():
        y, s = np.array(x).T
        points = []
        for t in {*s.tolist(), 0.0, 1.0, 1.0000000000000002}:
            p = s >= t
            tp, fp, fn = (p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum()
            points.append((2 * tp / (2 * tp + fp + fn), tp / (y == 1).sum(), fp / (y == 0).sum(), t))
        best[fold] = max((f1, t) for f1, _, _, t in points)[1], max((r, -q, t) for _, r, q, t in points if q <= 0.3 + 1e-12)[2]
    for r in got:
        assert (r.threshold_max_f1, r.threshold_operational) == best[r.fold]
        assert (r.prediction_max_f1, r.prediction_operational) == tuple(r.score >= t for t in best[r.fold])


@pytest.mark.parametrize("fault", ["twice", "gone", "unknown", "null", "no threshold"])
def test_out_of_fold_is_whole_or_an_error(spark, fault):
    validation, test, expected = parts(spark)
    if fault == "twice":
        test = test.unionAll(test.where("id = 7"))
    elif fault == "gone":
        test = test.where("id <> 7")
    elif fault == "unknown":
        expected = expected.where("id <> 7")
    elif fault == "null":
        test = test.withColumn("id", F.when(F.col("id") != 7, F.col("id")))
    else:
        validation = validation.where("fold <> 1")
    got = fz.out_of_fold(validation, test, expected, "fold", "id", "label", "score")
    with pytest.raises(Exception, match="out of fold"):
        got.select("prediction_max_f1").collect()
    with pytest.raises(Exception, match="out of fold"):
        got.count()


def test_logistic_equals_newton_on_raw_features(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(100, 5000, 300).astype(float), (rng.random(300) < 0.3).astype(float), rng.normal(size=300).round(1)])
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.0008 * (x[:, 0] - 2500) - 1.2 * x[:, 1] + 0.7 * x[:, 2])))).astype(int)
    rows = [(int(b), *map(float, v)) for b, v in zip(y, x, strict=True)] + [(1, None, 1.0, 0.0), (0, float("nan"), 0.0, 0.0), (None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "e int, a double, b double, c double")
    got = {r.feature: r.coefficient for r in qu.logistic_fit(df, "e", ["a", "b", "c"]).collect()}
    z, w, ridge = np.column_stack([x, np.ones(300)]), np.zeros(4), np.diag([1.0, 1, 1, 0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T * (p * (1 - p)) @ z + ridge, z.T @ (p - y) + ridge @ w)
    assert np.allclose([got["a"], got["b"], got["c"], got["intercept"]], w, rtol=1e-5, atol=1e-9)
    assert qu.logistic_fit(df.where("e = 1"), "e", ["a"]).count() == 0 and qu.logistic_fit(df.limit(0), "e", ["a"]).count() == 0
    # a separable target stays finite by the penalty
    apart = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 2.0), (1, 3.0)], "e int, a double")
    assert 0 < {r.feature: r.coefficient for r in qu.logistic_fit(apart, "e", ["a"]).collect()}["a"] < 5
