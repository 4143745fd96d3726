"""Ranked lexical search against scoring every document, and against SQL."""

from __future__ import annotations

import math
import random
import re

import pytest

from evidra.llm import lexical as lx
from tests.oracle import both

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top=10):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        asked = terms(text)
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in w for _, w in held) + 1))) for t in set(asked)}
        scored = []
        for i, w in held:
            m = 25 + 75 * len(w) * n_docs // n_terms
            s = sum(weight[t] * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in asked)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = lx.search(*lx.build_index(d), q, **how)
    return sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_equals_sql(spark, sf):
    a, b = both(spark, lx.op13_lexical_search, lx.ORACLES["op13_lexical_search"], sf)
    assert a == b and len(a[1]) > 50


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed, monkeypatch):
    """Many blocks, ties, repeated and null ids, several groups of queries, terms that no document has; bounds leave most blocks out."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)] + ["Éa", "éA", "日本", "x_y"]
    docs = [(rng.choice([None, *range(200)]), " ".join(rng.choices(pool, k=rng.randrange(0, 12)))) for _ in range(400)]
    docs += [(900 + i, "rare one here") for i in range(15)] + [(7, "x" * 20_000), (8, None), (9, " ...  ")]
    items = [(i, " ".join(rng.choices([*pool, "none"], k=4))) for i in range(12)] + [(50, "rare ONE"), (51, ""), (52, None), (53, "absent words"), (54, "rare rare")]
    want = brute(docs, items)
    monkeypatch.setattr(lx, "BLOCK_DOCS", 4)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, cells=60) == want


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a")], []) == []
    assert run(spark, [(1, None), (2, "--")], [(1, "a")]) == []


def test_bounds_prune(spark):
    """Blocks whose bound is below the threshold are not scored."""
    q = lx.Queries([(0, lx.term_hashes(*_raw("alpha beta"))[0])])
    q.docs, q.terms, q.weight, q.least = 100, 1000, lx.np.full(len(q.known), 500.0), lx.np.array([1e9])
    seen = []
    import pyarrow as pa

    parts = lx._block(lx.term_hashes(*_raw("alpha gamma"))[0], lx.np.array([0, 2]), lx.np.array([5]), 100, 1000)
    batch = pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([0, *parts], lx._BLOCK, strict=True)], schema=lx._BLOCK)
    real = lx._scores
    lx._scores = lambda *a: seen.append(1) or real(*a)
    try:
        for least in (1e9, 1.0):
            q.least = lx.np.array([least])
            rows = next(lx._search(type("B", (), {"value": q}), 10)(iter([batch]))).num_rows
            assert (rows, len(seen)) == ((0, 0) if least == 1e9 else (1, 1))
    finally:
        lx._scores = real


def _raw(text):
    raw = lx.np.frombuffer(text.encode(), lx.np.uint8)
    return raw, lx.np.array([0, len(raw)])


def test_index_is_read_in_small_pieces(spark):
    """Blocks of long texts: row groups of the index, which a reader holds whole, stay small."""
    import pyarrow.parquet as pq

    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(900))) for i in range(2000)]
    index, docs, n = lx.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    groups = [g for f in index.inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for g in map(m.row_group, range(m.num_row_groups))]
    assert docs == 2000 and sum(g.num_rows for g in groups) > 60
    assert max(g.total_byte_size for g in groups) < 16 << 20
