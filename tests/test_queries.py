from __future__ import annotations

import os
import re

import numpy as np
import pytest

from evidra.plans import audits, builds, datasets, learned, stores  # noqa: F401  register their queries
from evidra.plans import queries as q
from tests.oracle import both

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_equals_sql(spark, name):
    ours, theirs = both(spark, q.QUERIES[name], q.ORACLES[name], SF)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_runs(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0


def test_claims_equal_brute(spark):
    """sentence_claims and labelled_claims against a plain loop over whole texts."""
    from tests.test_text import cut

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    words = re.compile(r"\w+")
    want = {(i, k, a, b) for i, t in docs.items() for k, (a, b) in enumerate(cut(t)) if len(words.findall(t[a:b])) >= 3}
    got = {(r.doc_id, r.claim_index, r.claim_start, r.claim_end) for r in q.QUERIES["sentence_claims"](spark, SF).collect()}
    assert got == want
    spans = {}
    for r in q._claims_spans(spark, SF)[1].collect():
        spans.setdefault(r.doc_id, []).append((r.span_start, r.span_end))
    want = set()
    for i, t in docs.items():
        out = []
        for a, b in cut(t):
            if out and any(s < out[-1][1] and e > a for s, e in spans.get(i, [])):
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        want |= {(i, k, a, b, any(s < b and e > a for s, e in spans.get(i, []))) for k, (a, b) in enumerate(out) if len(words.findall(t[a:b])) >= 3}
    assert {(r.doc_id, r.claim_index, r.claim_start, r.claim_end, r.label) for r in q.QUERIES["labelled_claims"](spark, SF).collect()} == want


def test_splits_keep_groups(spark):
    for name in ("grouped_split", "k_folds"):
        rows = q.QUERIES[name](spark, SF).collect()
        assert len(rows) == len({r.group for r in rows}) and len({r[1] for r in rows}) > 1
    nested = q.QUERIES["nested_folds"](spark, SF).collect()
    groups = {r.group for r in nested}
    for outer in range(5):
        some = [r for r in nested if r.outer == outer]
        assert {r.group for r in some} == groups and len(some) == len(groups)
        assert {r.inner for r in some if r.role == "train"} == set(range(5)) and {r.inner for r in some if r.role == "test"} == {-1}
    assert sorted(r.group for r in nested if r.role == "test") == sorted(groups)


def test_models_equal_newton(spark):
    """Logistic coefficients against Newton's method; the surface baseline is better than chance on held-out groups."""
    from evidra.operators import quality as qu

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2)) * [3, 0.5] + [10, 1]
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.4 * (x[:, 0] - 10) - 1.5 * (x[:, 1] - 1) + 0.2)))).astype(int)
    df = spark.createDataFrame([(int(b), float(u), float(v)) for b, (u, v) in zip(y, x, strict=True)] + [(1, None, 2.0)], "e int, u double, v double")
    got = {r.feature: r.coefficient for r in qu.error_model(df, "e", ["u", "v"]).collect()}
    z = np.column_stack([(x - x.mean(0)) / x.std(0, ddof=1), np.ones(400)])
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1e-3, 0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T * (p * (1 - p)) @ z / 400 + ridge, z.T @ (p - y) / 400 + ridge @ w)
    assert np.allclose([got["u"], got["v"], got["intercept"]], w, atol=1e-3)
    assert qu.error_model(df.where("e = 1"), "e", ["u", "v"]).count() == 0
    base = q.QUERIES["surface_baseline"](spark, SF).collect()
    assert base and {r.predicted for r in base} <= {0, 1}


def test_support_scores_equal_brute(spark):
    rows = {r.doc_id: r for r in q.QUERIES["support_scores"](spark, SF).collect()}
    docs = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for i, r in rows.items():
        e = [((i * a + 7) % 1000) / 1000 for a, k in zip((7919, 104729, 6101, 8191), range(4), strict=True) if docs[i] > 400 * k]
        assert r.support == (max(e) if e else None)


def test_replicates_equal_plan(spark):
    """The matrix form of the bootstrap against the plan of expressions."""
    from evidra.operators import bootstrap as bs

    cube, draws = q.cube(spark, SF), bs.multiplicities(q.scored(spark, SF).select("source"), "source", 7)
    forms = [f(cube, draws, "source", ["condition", "seed"], "label", "score").collect() for f in (bs.replicate_metrics, bs.replicate_metrics_matrix)]
    a, b = ({(r.replicate_id, r.condition, r.seed): r for r in x} for x in forms)
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k].n, a[k].positives, a[k].valid) == (b[k].n, b[k].positives, b[k].valid)
        assert all(np.isclose(a[k][m], b[k][m]) for m in ("average_precision", "auroc", "brier") if a[k].valid)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(q.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_blank_slots_are_like_nothing(spark, tmp_path):
    rows = [(1, i, "user", t) for i, t in enumerate(["", "  ", "a b", "A  b"])] + [(2, 0, "user", None), (2, 1, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.slot_a, r.slot_b): (r.jaccard, r.near) for r in q.QUERIES["slot_similarity"](spark, str(tmp_path)).collect()}
    assert got.pop((1, 3, 4)) == (1.0, True) and len(got) == 6 and set(got.values()) == {(0.0, False)}


def test_surface_baseline_reads_texts_once(spark):
    assert not any("documents.parquet" in f for f in q.QUERIES["surface_baseline"](spark, SF).inputFiles())
