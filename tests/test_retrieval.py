from __future__ import annotations

import math
import re
from collections import Counter

from evidra.operators import retrieval as rt


def brute(claim, units, k=4, most=128):
    """(unit id, score) of the k slots, (None, None) where there is no unit."""
    units = [(i, t.strip()) for i, t in units if t and t.strip()][:most]
    if len(units) <= k:
        return [(i, None) for i, _ in units] + [(None, None)] * (k - len(units))
    bags = []
    for t in (claim, *(t for _, t in units)):
        w = re.findall(r"\b\w+\b", t.lower())
        bags.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    df = Counter(x for b in bags for x in b)
    rows = []
    for b in bags:
        v = {x: n * (math.log((1 + len(bags)) / (1 + df[x])) + 1) for x, n in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        rows.append({x: y / norm for x, y in v.items()})
    scores = [sum(y * rows[0].get(x, 0.0) for x, y in r.items()) for r in rows[1:]]
    order = sorted(range(len(units)), key=lambda j: -round(scores[j], 9))[:k]
    return [(units[j][0], scores[j]) for j in order]


def test_tfidf_equals_brute(spark):
    """One-character words, units without a term, blank ones, small groups, a null claim, no unit at all, more than 128 units, an unknown group."""
    groups = {
        1: ("is 5 a b the answer", ["5", "a b", "I", "?", "the answer is 5", "  ", "answer", "x y z"]),
        2: ("plan b", ["!", "5", "plan", None, "?"]),
        3: ("c d", ["...", "?", "zz yy", "!!", "qq", ""]),
        4: ("?", ["one", "two", "three", "4", "five"]),
        5: ("alone", ["?"]),
        6: (None, ["a b", "c", "d", "e", "f f"]),
        7: ("nothing", ["  ", None]),
        8: ("w7 w7 x w150", [f" w{i} x {i % 7} " if i % 5 else " " for i in range(200)]),
    }
    claims = spark.createDataFrame([(g, g * 1000 + 999, c) for g, (c, _) in groups.items()], "g long, id long, text string")
    units = spark.createDataFrame([(g, g * 1000 + i, t) for g, (_, u) in groups.items() for i, t in enumerate(u)], "g long, id long, text string")
    claims = claims.unionAll(spark.createDataFrame([(None, 9999, "x"), (55, 55999, "x")], claims.schema))
    got = {}
    for r in sorted(rt.tfidf_top_k(claims, units, "g", "id", "id", "text").collect(), key=lambda r: r["rank"]):
        assert r.mask == (r.unit_id is not None)
        got.setdefault(r.claim_id // 1000, []).append((r.unit_id, r.score))
    assert got[9] == got[55] == [(None, None)] * 4
    for g, (c, u) in groups.items():
        want = brute(c or "", [(g * 1000 + i, t) for i, t in enumerate(u)])
        assert [i for i, _ in got[g]] == [i for i, _ in want]
        for (_, a), (_, b) in zip(got[g], want, strict=True):
            assert (a is None and b is None) or abs(a - b) < 1e-9
