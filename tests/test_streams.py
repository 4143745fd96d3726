"""Draw streams and the bootstraps on them against numpy itself."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import streams as st


@pytest.mark.parametrize("count", [2, 3, 23, 1 << 20, 3_000_000_019, (1 << 31) + 1, (1 << 32) - 1])
def test_numbers_equal_numpy(count):
    """Whatever share of outputs is rejected, over several blocks."""
    value, ok = map(np.concatenate, zip(*[st.bounded(st.outputs(7, b, 64), count) for b in range(5)], strict=True))
    got = value[ok]
    assert (got == np.random.default_rng(7).integers(0, count, len(got))).all() and len(got) > 200


def counts(rng, n, replicates):
    return {(r, int(i)): int(w) for r in range(replicates) for i, w in zip(*np.unique(rng.choice(n, n, replace=True), return_counts=True), strict=True)}


@pytest.mark.parametrize("count, replicates, skip, size", [(23, 10_000, 0, st.OUTPUTS), (23, 40, 23 * 17, 16), (1, 5, 3, 16), (1000, 7, 1, 64)])
def test_draws_equal_numpy(spark, count, replicates, skip, size):
    got = {(r.replicate_id, r.i): r.w for r in st.draws(spark, count, replicates, 20260815, skip, size).collect()}
    rng = np.random.default_rng(20260815)
    rng.choice(count, skip, replace=True)
    assert got == counts(rng, count, replicates)


def test_order_of_groups(spark):
    rows = [("b", 0), ("a", 1), ("b", 2), ("c", 3), (None, 4), ("é", 5)]
    df = spark.createDataFrame(rows, "g string, pos long").repartition(3)
    for order, names in ((None, ["a", "b", "c", "é"]), ("pos", ["b", "a", "c", "é"])):
        got = {(r.replicate_id, r.group): r.w for r in st.stream_multiplicities(df, "g", 30, 5, order).collect()}
        assert got == {(r, names[i]): w for (r, i), w in counts(np.random.default_rng(5), 4, 30).items()}
    assert st.stream_multiplicities(df.where("false"), "g", 3, 1).collect() == []
    with pytest.raises(ValueError, match="a group"):
        st.draws(spark, 0, 1, 1)


def rates(y, p):
    tp, fp, fn, tn = ((y & p).sum(), (~y & p).sum(), (y & ~p).sum(), (~y & ~p).sum())
    d = lambda a, b: float(a) / float(b) if b else 0.0
    root = np.sqrt(float(tp + fp) * float(tp + fn) * float(tn + fp) * float(tn + fn))
    return {"F1": d(2 * tp, 2 * tp + fp + fn), "Recall": d(tp, tp + fn), "FPR": d(fp, fp + tn), "MCC": d(float(tp) * tn - float(fp) * fn, root)}


def precision(y, s):
    """Average precision, equal scores as one step."""
    if not y.any():
        return 0.0
    out = last = 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall = (y & hit).sum() / y.sum()
        out, last = out + (recall - last) * (y & hit).sum() / hit.sum(), recall
    return out


def population(seed, n=120, groups=6):
    rng = np.random.default_rng(seed)
    return rng.choice([f"g{i}" for i in range(groups)], n), rng.random(n) < 0.15, rng.integers(0, 12, n) / 12, rng.integers(0, 12, n) / 12


def test_paired_cluster_equals_loop(spark):
    g, y, a, b = population(3)
    y &= np.isin(g, ["g0", "g1"])  # some replicates have no positives
    df = spark.createDataFrame(list(zip(map(str, g), y.astype(int).tolist(), a.tolist(), b.tolist(), strict=True)), "g string, y int, a double, b double")
    got = {r.metric: r for r in st.paired_cluster(df, "g", "y", (F.col("a") >= 0.5, "a"), (F.col("b") >= 0.4, "b"), 25, 11).collect()}
    rng, names = np.random.default_rng(11), np.unique(g)
    one = 0
    for m in st.PAIRED:
        value = lambda at: (precision(y[at], a[at]) - precision(y[at], b[at])) if m == "AUPRC" else rates(y[at], a[at] >= 0.5)[m] - rates(y[at], b[at] >= 0.4)[m]  # noqa: B023, E731
        d = []
        for _ in range(25):
            at = np.concatenate([np.flatnonzero(g == x) for x in rng.choice(names, len(names), replace=True)])
            one += not y[at].any()
            d.append(value(at))
        low, high = np.quantile(d, [0.025, 0.975])
        r = got[m]
        want = (value(np.arange(len(y))), low, high, np.mean(np.array(d) < 0 if m == "FPR" else np.array(d) > 0))
        assert np.allclose((r.difference_first_minus_second, r.ci95_lower, r.ci95_upper, r.probability_first_better), want, atol=1e-9), m
    assert one


def test_bucket_intervals_equal_loop(spark):
    g, y, s, q = population(4)
    b = (q * 3).astype(int)
    y &= (b != 2)  # a bucket of one class
    rows = list(zip(map(str, g), y.astype(int).tolist(), s.tolist(), b.tolist(), strict=True)) + [("g0", 1, 0.5, None), (None, 1, 0.5, 0)]
    got = {r.b: r for r in st.bucket_intervals(spark.createDataFrame(rows, "g string, y int, s double, b int"), "b", "g", "y", "s", 30, 9).collect()}
    assert sorted(got) == [0, 1, 2]
    for k in range(3):
        mine = b == k
        yk, sk, gk = y[mine], s[mine], g[mine]
        rng, names, values = np.random.default_rng(9), np.unique(gk), []
        for _ in range(30):
            at = np.concatenate([np.flatnonzero(gk == x) for x in rng.choice(names, len(names), replace=True)])
            if len(set(yk[at])) == 2:
                values.append(precision(yk[at], sk[at]))
        assert (got[k].n_valid, got[k].n_one_class) == (len(values), 30 - len(values))
        if values:
            assert np.allclose((got[k].ci95_lower, got[k].ci95_upper), np.quantile(values, [0.025, 0.975]), atol=1e-9)
        else:
            assert got[k].ci95_lower is None
