from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.functions.scalars import ABOVE_ONE
from evidra.operators import bootstrap as bs
from evidra.operators import metrics as me
from evidra.operators import report as rp


def frame(spark, y, s, g=None):
    return spark.createDataFrame([(int(a), float(b), str(c)) for a, b, c in zip(y, s, g or ["g"] * len(y), strict=True)], "label int, score double, grp string")


def brute(y, s):
    """Average precision and AUROC by definition."""
    y, s = np.array(y), np.array(s)
    ap = last = 0.0
    for t in sorted(set(s), reverse=True):
        r = y[s >= t].sum() / y.sum()
        ap += (r - last) * y[s >= t].mean()
        last = r
    p, n = s[y == 1], s[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])
    return ap, auc, np.mean((s - y) ** 2)


@pytest.mark.parametrize("seed", range(3))
def test_ranking(spark, seed):
    rng = np.random.default_rng(seed)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 30, 200) / 30
    r = me.ranking(frame(spark, y, s), [], "label", "score").first()
    assert np.allclose([r.average_precision, r.auroc, r.brier], brute(y, s))


def test_one_class_has_no_auroc(spark):
    assert me.ranking(frame(spark, [1, 1], [0.1, 0.9]), [], "label", "score").first().auroc is None


def test_thresholds(spark):
    p = me.operating_points(frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.7, 0.9]), [], "label", "score")
    best = me.select_threshold(p, [], "f1").first()
    assert best.f1 == 1 and 0.2 < best.threshold <= 0.7
    assert {r.threshold for r in p.collect()} == {0.0, 0.1, 0.2, 0.7, 0.9, 1.0, ABOVE_ONE}
    p = me.operating_points(frame(spark, [0, 0, 0, 1, 1], [0.1, 0.2, 0.8, 0.7, 0.9]), [], "label", "score")
    assert me.select_threshold(p, [], "fpr").first().fpr <= 0.10


def test_equality_is_positive(spark):
    r = me.confusion(frame(spark, [1, 0], [0.5, 0.4]), [], "label", F.col("score") >= 0.5).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 0, 1, 0)


def test_bootstrap_equals_resampling(spark):
    rng = np.random.default_rng(4)
    y, s, g = rng.integers(0, 2, 120), rng.integers(0, 50, 120) / 50, [f"h{i % 9}" for i in range(120)]
    rows = frame(spark, y, s, g)
    draws = bs.numpy_multiplicities(spark, g, 6, 20260815)
    got = {r.replicate_id: r for r in bs.replicate_metrics(rows, draws, "grp", [], "label", "score").collect()}
    gen = np.random.default_rng(20260815)
    names = sorted(set(g))
    for k in range(6):
        at = np.concatenate([[i for i, x in enumerate(g) if x == names[j]] for j in gen.integers(0, len(names), len(names))])
        want = brute(y[at], s[at])
        assert np.allclose([got[k].average_precision, got[k].auroc, got[k].brier], want)


def test_single_class_replicates_stay(spark):
    rows = frame(spark, [1, 0], [0.9, 0.1], ["a", "b"])
    draws = spark.createDataFrame([(0, "a", 2), (1, "a", 1), (1, "b", 1)], "replicate_id long, group string, w long")
    got = {r.replicate_id: r for r in bs.replicate_metrics(rows, draws, "grp", [], "label", "score").collect()}
    assert not got[0].valid and got[0].auroc is None and got[1].valid and got[1].auroc == 1


def test_orientation_and_verdict(spark):
    v = spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.0)], "k int, condition string, value double")
    assert bs.contrasts(v, ["k"], "condition", {"b_a": ("a", "b")}).first().delta == 2.0
    d = spark.createDataFrame([("f1", 0.1, 0.2), ("brier", 0.1, 0.2), ("brier", -0.2, -0.1), ("f1", -0.1, 0.1)], "metric string, ci_low double, ci_high double")
    assert [r[0] for r in d.select(bs.verdict()).collect()] == ["FAVOR_B", "FAVOR_A", "FAVOR_B", "INCONCLUSIVE"]
    e = d.withColumns({"contrast_family": F.lit("translation_interaction"), "significant_direction": F.lit("POSITIVE")})
    assert [r.expected for r in rp.direction_mismatches(e).collect()] == ["NEGATIVE", "INCONCLUSIVE"]
