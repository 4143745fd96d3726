from __future__ import annotations

import random

import numpy as np
import pytest

from evidra.llm import near_dedup
from tests.llm.test_ops import brute_components, shingles


def test_sketch_never_exceeds_difference():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, k = int(rng.integers(5, 6000)), float(rng.uniform(0, 1))
        common = rng.integers(0, 2**63, int(n * k), dtype=np.uint64)
        x, y = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)])) for _ in "ab")
        s = near_dedup.parity_sketch(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])).view(np.uint64)
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(np.setxor1d(x, y))


def cloud(seed: int, n: int) -> list[str]:
    """Edits of one text, most pairs of which are under the bound, some above."""
    rng = random.Random(seed)
    base = [f"t{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for j in rng.sample(range(120), rng.choice([1, 2, 4, 5, 6])):
            w[j] = f"e{i}_{j}" if rng.random() < 0.7 else f"s{j}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("cell", [7, 1024])
def test_cloud_of_edits(spark, monkeypatch, cell):
    monkeypatch.setattr(near_dedup, "CELL", cell)
    texts = cloud(11, 120) + cloud(12, 40)
    got = near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    want = brute_components({i: shingles(t) for i, t in enumerate(texts)})
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) > 2


def test_repeated_rows_null_and_shared_ids(spark):
    long = [" ".join(f"{p}{i}" for i in range(30)) for p in "abcd"]
    rows = [(1, long[0])] * 3 + [(None, long[0]), (None, None), (2, long[0]), (3, long[1]), (3, long[2]), (4, long[1]), (5, long[2] + " x"), (6, long[3]), (7, ""), (7, "")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = near_dedup.near_groups(df).collect()
        assert len(got) == len(rows)
        by = {r.doc_id: r.component_id for r in got}
        assert by == {None: None, 1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None) and all(r.kept for r in got if r.doc_id is None)
        assert near_dedup.drop_near(df).count() == len(rows) - 3
