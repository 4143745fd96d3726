"""Splits of exact sizes against plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from evidra.operators import splits as sp

P = 2_147_483_647


def table(spark, sizes, extra=()):
    rows = [(g, int(i < p)) for g, (n, p) in sizes.items() for i in range(n)]
    return spark.createDataFrame([*rows, *extra], "g long, y int")


def made(seed, n=40):
    rng = random.Random(seed)
    return {g: (k := rng.randrange(1, 9), rng.choice([0, 0, rng.randrange(0, k + 1)])) for g in rng.sample(range(1000), n)}


def draws(sizes, fraction, candidates, seed):
    strata = {s: [g for g in sizes if (sizes[g][1] > 0) == s] for s in (False, True)}
    total = len(sizes)
    size = max(2, math.ceil(fraction * total))
    size = total - 2 if size >= total else size
    share = {s: size * len(v) // total for s, v in strata.items()}
    for s in sorted(strata, key=lambda s: (-(size * len(strata[s]) % total), s))[: size - sum(share.values())]:
        share[s] += 1

    def h(g, c):
        x = (g * 48_271 + c * 16_807 + seed * 7_919 + 11) % P
        return ((x * 69_621 + 7) % P * 39_373 + 13) % P

    for c in range(candidates):
        yield sorted(g for s, v in strata.items() for g in sorted(v, key=lambda g: (h(g, c), g))[: share[s]])


@pytest.mark.parametrize("seed", range(3))
def test_fixed_split_equals_loop(spark, seed):
    sizes = made(seed)
    rows, pos = sum(n for n, _ in sizes.values()), sum(p for _, p in sizes.values())

    def loss(v):
        n, p = sum(sizes[g][0] for g in v), sum(sizes[g][1] for g in v)
        return round(abs(len(v) / len(sizes) - 0.15) + abs(n / rows - 0.15) + 2 * abs(p / n - pos / rows), 12)

    want = min((loss(v), v) for v in draws(sizes, 0.15, 16, seed))[1]
    got = sp.fixed_group_split(table(spark, sizes, [(None, 1), (min(sizes), None)][:1]), "g", "y", 0.15, 16, seed).collect()
    assert sorted(r.group for r in got if r.partition == "validation") == want and len(got) == len(sizes)
    assert {r.group: (r.n, r.p) for r in got} == sizes


def test_fixed_split_ties_and_errors(spark):
    """Equal groups make every draw equally good: the one whose groups come first is taken."""
    sizes = {g: (2, g % 2) for g in range(12)}
    want = min(draws(sizes, 0.3, 8, 0))
    got = sp.fixed_group_split(table(spark, sizes), "g", "y", 0.3, 8).where("partition = 'validation'")
    assert sorted(r.group for r in got.collect()) == want
    for bad in ({1: (2, 1), 2: (2, 0), 3: (1, 0)}, {g: (2, 1) for g in range(9)}, {}):
        with pytest.raises(ValueError, match="two groups"):
            sp.fixed_group_split(table(spark, bad), "g", "y", 0.2)
    with pytest.raises(ValueError, match="fraction"):
        sp.fixed_group_split(table(spark, sizes), "g", "y", 1.0)


@pytest.mark.parametrize("sizes", [{g: (2 + g % 3, 1 + g % 2) for g in range(9)}, {g: (2 + g % 3, 0) for g in range(9)}, {g: (3, int(g == 4)) for g in range(9)}, {1: (2, 1), 2: (3, 0), 5: (1, 1)}, {1: (2, 1), 2: (2, 0)}, {1: (2, 1)}, {}])
def test_fixed_split_of_one_kind(spark, sizes):
    """Strata that are absent or of one group, by the query's SQL."""
    from evidra.plans import learned  # noqa: F401  registers its queries
    from evidra.plans import queries as q

    rows, pos = sum(n for n, _ in sizes.values()), sum(p for _, p in sizes.values())

    def loss(v):
        n, p = sum(sizes[g][0] for g in v), sum(sizes[g][1] for g in v)
        return round(abs(len(v) / len(sizes) - 0.2) + abs(n / rows - 0.2) + 2 * abs(p / n - pos / rows), 12)

    want = min(((loss(v), v) for v in draws(sizes, 0.2, sp.CANDIDATES, 0)), default=None)[1] if len(sizes) > 2 else []
    got = sp.fixed_group_split(table(spark, sizes), "g", "y", 0.2, strict=False).collect()
    assert sorted(r.group for r in got if r.partition == "validation") == want and {r.group: (r.n, r.p) for r in got} == sizes
    if not sizes:
        return  # the SQL divides by the number of groups
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR)")
    con.execute("CREATE TABLE labels (doc_id BIGINT, toxic INTEGER)")
    for k, (g, i, p) in enumerate((g, i, p) for g, (n, p) in sizes.items() for i in range(n)):
        con.execute("INSERT INTO documents VALUES (?, ?)", [k, f"src{g}"])
        con.execute("INSERT INTO labels VALUES (?, ?)", [k, int(i < p)])
    assert sorted((r.group, r.partition, r.n, r.p) for r in got) == sorted(con.execute(q.ORACLES["fixed_size_split"]).fetchall())


@pytest.mark.parametrize("bins", [1, 7, 5000])
def test_smallest(spark, bins):
    rng = random.Random(bins)
    rows = [(i, i % 3, rng.choice([5, 5, rng.randrange(P)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, key int, h long")
    got = sp.smallest(df, ["key"], "h", ["id"], F.col("key") * 50, bins)
    want = {i for k in range(3) for i in [x[0] for x in sorted((x for x in rows if x[1] == k), key=lambda x: (x[2], x[0]))[: 50 * k]]}
    assert {r.id for r in got.collect()} == want and got.columns == df.columns


def order(spark, groups, seed):
    """Groups of (group, n, p) as the greedy run takes them."""
    df = spark.createDataFrame(groups, "group long, n long, p long").withColumn("h", F.xxhash64(F.col("group").cast("string"), F.lit(seed)))
    return sorted(((r.group, r.n, r.p, r.h) for r in df.collect()), key=lambda r: (-abs(r[1] - 2 * r[2]), r[3], r[0]))


def loop(groups, k):
    """Fold of each group, by trying every fold and measuring the spread of shares anew."""
    tot = [max(sum(n - p for _, n, p, _ in groups), 1), max(sum(p for _, _, p, _ in groups), 1)]
    held = [[0, 0] for _ in range(k)]
    out = {}
    for g, n, p, _ in groups:
        best = None
        for f in range(k):
            trial = [[a + (n - p) * (i == f), b + p * (i == f)] for i, (a, b) in enumerate(held)]
            spread = 0.0
            for c in (0, 1):
                x = [t[c] / tot[c] for t in trial]
                spread += math.sqrt(sum((v - sum(x) / k) ** 2 for v in x) / k) / 2
            key = (round(spread, 12), sum(held[f]), f)
            best = min(best or key, key)
        f = best[2]
        held[f][0] += n - p
        held[f][1] += p
        out[g] = f
    return out


@pytest.mark.parametrize("seed", range(2))
def test_nested_folds_equal_loop(spark, seed):
    sizes = made(seed + 10, 35)
    got = sp.nested_group_folds(table(spark, sizes), "g", "y", 4, 3, seed).collect()
    groups = [(g, n, p) for g, (n, p) in sizes.items()]
    outer = loop(order(spark, groups, seed), 4)
    want = {}
    for o in range(4):
        rest = [x for x in groups if outer[x[0]] != o]
        inner = loop(order(spark, rest, seed + 1000), 3)
        n, p = sum(x[1] for x in rest), sum(x[2] for x in rest)
        score = []
        for f in range(3):
            v = [x for x in rest if inner[x[0]] == f]
            vn, vp = sum(x[1] for x in v), sum(x[2] for x in v)
            score.append((round(abs(vp / vn - p / n) + 0.25 * abs(vn / n - 1 / 3), 12), f))
        chosen = min(score)[1]
        want |= {(o, g): "test" if outer[g] == o else "validation" if inner[g] == chosen else "train" for g in sizes}
    assert {(r.outer_fold, r.group): r.role for r in got} == want


def test_blocks_stay_even_and_faults_are_found(spark):
    sizes = made(3, 300)
    df = table(spark, sizes)
    got = sp.nested_group_folds(df, "g", "y", 5, 4, 1, block=40)
    assert sp.fold_faults(got, df, "g", 5).collect() == []
    n, p = sum(x for x, _ in sizes.values()), sum(x for _, x in sizes.values())
    for r in got.where("role = 'test'").groupBy("outer_fold").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect():
        assert abs(r.n / n - 0.2) < 0.03 and abs(r.p / r.n - p / n) < 0.05
    leak = got.unionByName(got.where("outer_fold = 0 AND role = 'test'").limit(1).withColumn("role", F.lit("train")))
    assert [(r.outer_fold, r.fault) for r in sp.fold_faults(leak, df, "g", 5).collect()] == [(0, "leak")]
    one = got.where("role = 'test'").first()["group"]
    gap = got.where(f"NOT (role = 'test' AND group = {one})")
    assert [(r.group, r.fault) for r in sp.fold_faults(gap, df, "g", 5).collect()] == [(one, "coverage")]


def test_one_class_is_an_error(spark):
    with pytest.raises(ValueError, match="lacks one"):
        sp.nested_group_folds(table(spark, {g: (3, 0) for g in range(30)}), "g", "y")


def test_limits(spark):
    g = sp.totals(table(spark, {1: (1, 0), 2: (1, 0), 3: (2, 1), 4: (1, 1)}), "g", "y")
    take = lambda k: [r.group for r in sp.limited_groups(g, k).collect()]
    assert [sorted(take(k)) for k in (0, 1, 2, 3)] == [[3], [3], [1, 3], [1, 2, 3]] and len(take(None)) == 4
