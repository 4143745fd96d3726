"""Pooling heads against plain loops over one bag, invariance, masks, errors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import pooling as po

KINDS = {"mean": {}, "max": {}, "gated_attention": {"attention": 3}, "set_transformer": {"hidden": 10}}


def head(kind, width=6):
    return po.Head.drawn(kind, width, seed=5, lanes=2, **KINDS[kind])


def some(n=40, slots=4, width=6, seed=1):
    rng = np.random.default_rng(seed)
    mask = rng.random((n, slots)) < 0.6
    mask[np.arange(n), rng.integers(slots, size=n)] = True
    return rng.normal(size=(n, slots, width)), mask


def lane_attention(v, block, asks, holds, lanes):
    """Multi-head attention, residual, norm, feed-forward, residual, norm; one vector at a time. holds are valid ones only."""
    def norm(x, n):
        m, s = sum(x) / len(x), sum((a - sum(x) / len(x)) ** 2 for a in x) / len(x)
        return np.array([(a - m) / math.sqrt(s + 1e-5) for a in x]) * v[f"{block}_{n}"] + v[f"{block}_{n}_shift"]

    lin = lambda n, x: v[f"{block}_{n}"] @ x + v[f"{block}_{n}_shift"]
    size = len(asks[0]) // lanes
    outs, shares = [], []
    for a in asks:
        joined, share = [], np.zeros(len(holds))
        for h in range(lanes):
            part = slice(h * size, (h + 1) * size)
            e = [math.exp(lin("query", a)[part] @ lin("key", x)[part] / math.sqrt(size)) for x in holds]
            share += np.array(e) / sum(e) / lanes
            joined.append(sum(w / sum(e) * lin("value", x)[part] for w, x in zip(e, holds, strict=True)))
        y = norm(a + lin("out", np.concatenate(joined)), "norm1")
        wide = np.array([z * 0.5 * (1 + math.erf(z / math.sqrt(2))) for z in lin("wide", y)])
        outs.append(norm(y + lin("narrow", wide), "norm2"))
        shares.append(share)
    return outs, shares


def plain(h, x, mask):
    """One bag, valid slots only."""
    at = np.flatnonzero(mask)
    z, v = x[at], h.values
    w = np.zeros(len(x))
    if h.kind == "mean":
        w[at] = 1 / len(at)
        return z.mean(axis=0), w
    if h.kind == "max":
        for j in range(x.shape[1]):
            w[at[int(np.argmax(z[:, j]))]] += 1 / x.shape[1]
        return z.max(axis=0), w
    if h.kind == "gated_attention":
        e = [math.exp(sum(u * math.tanh(t) / (1 + math.exp(-g)) for u, t, g in zip(v["weigh"], v["tanh"] @ y + v["tanh_shift"], v["gate"] @ y + v["gate_shift"], strict=True))) for y in z]
        w[at] = np.array(e) / sum(e)
        return w[at] @ z, w
    inner, _ = lane_attention(v, "set", z, z, h.lanes)
    out, share = lane_attention(v, "pool", v["seed"], inner, h.lanes)
    w[at] = share[0]
    return out[0], w


@pytest.mark.parametrize("kind", KINDS)
def test_equals_plain_loop(kind):
    h, (x, mask) = head(kind), some()
    pooled, weights = h.pooled(x, mask)
    for i in range(len(x)):
        p, w = plain(h, x[i], mask[i])
        assert np.allclose(pooled[i], p, atol=1e-9) and np.allclose(weights[i], w, atol=1e-9)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[~mask] == 0).all()


@pytest.mark.parametrize("kind", KINDS)
def test_order_and_masked_content_do_not_matter(kind):
    h, (x, mask) = head(kind), some(seed=2)
    pooled, weights = h.pooled(x, mask)
    at = [2, 0, 3, 1]
    again, moved = h.pooled(x[:, at], mask[:, at])
    assert np.allclose(pooled, again) and np.allclose(weights[:, at], moved)
    other = np.where(mask[:, :, None], x, np.nan)
    assert np.allclose(pooled, h.pooled(other, mask)[0])


def test_one_valid_slot_and_none():
    x, mask = np.ones((1, 4, 6)), np.array([[False, False, True, False]])
    for kind in KINDS:
        assert np.allclose(head(kind).pooled(x, mask)[1], [[0, 0, 1, 0]])
        with pytest.raises(ValueError, match="valid slot"):
            head(kind).pooled(x, np.zeros((1, 4), bool))
    with pytest.raises(ValueError, match="unknown head"):
        po.Head.drawn("median", 6)


def test_bags_and_pool(spark, monkeypatch):
    rows = [("a", 0, [1.0, 2.0]), ("a", 3, [5.0, 6.0]), ("a", 3, [9.0, 9.0]), ("a", 1, None), ("b", 2, [3.0, 4.0]), ("c", 1, [0.0, 0.0]), (None, 0, [7.0, 7.0])]
    df = spark.createDataFrame(rows, "k string, slot int, vectors array<float>")
    got = po.bags(df, ["k"], "slot", "vectors", F.col("k").isNull() | (F.col("k") != "c"), 2)
    assert {r.k: (r.vectors, r.mask) for r in got.collect()} == {
        "a": ([1, 2, 0, 0, 0, 0, 5, 6], [True, False, False, True]),
        "b": ([0, 0, 0, 0, 3, 4, 0, 0], [False, False, True, False]),
        None: ([7, 7, 0, 0, 0, 0, 0, 0], [True, False, False, False]),
    }
    monkeypatch.setattr(po, "CELLS", 8)
    heads = {k: po.Head.drawn(k, 2, seed=1, lanes=1) for k in KINDS}
    out = {(r.k, r.head): r for r in po.pool(got, heads, ["k"]).collect()}
    assert len(out) == 3 * len(KINDS)
    for r in got.collect():
        for k, h in heads.items():
            p, w = plain(h, np.array(r.vectors).reshape(4, 2), np.array(r.mask))
            assert np.allclose(out[r.k, k].pooled, p) and np.allclose(out[r.k, k].weights, w) and math.isclose(out[r.k, k].logit, h.logits(p[None])[0], abs_tol=1e-9)
    assert po.pool(got.where("false"), heads, ["k"]).collect() == []
    for bad in ([("a", 0, [1.0])], [("a", 4, [1.0, 2.0])]):
        with pytest.raises(Exception, match="a slot of 2 numbers"):
            po.bags(spark.createDataFrame(bad, df.schema), ["k"], "slot", "vectors", F.lit(True), 2).collect()
