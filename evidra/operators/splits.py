"""Splits by group that hold exact sizes: stratified draws of a fixed number of groups, nested greedy folds, limits.

All work on group totals (group, n, p): rows and positives of each group, one aggregate over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.sources.writers import settled

#: Candidate draws; bins of the draws' hashes; groups of one greedy block.
CANDIDATES, BINS, BLOCK = 128, 1024, 4096
_PRIME = 2_147_483_647


def totals(df: DataFrame, group: str, label: str) -> DataFrame:
    """group, n, p, positive (whether any row is): null groups are left out, a null label counts as negative."""
    g = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), F.sum((F.coalesce(F.col(label).cast("int"), F.lit(0)) == 1).cast("long")).alias("p"))
    return g.withColumn("positive", F.col("p") > 0)


def draw(key: Column, candidate: Column, seed: int) -> Column:
    """A hash in 0 to 2^31 - 2 of an integer key and a candidate, by linear congruences that any engine can follow."""
    x = F.pmod(key.cast("long") * 48_271 + candidate.cast("long") * 16_807 + F.lit(seed * 7_919 + 11).cast("long"), F.lit(_PRIME))
    x = F.pmod(x * 69_621 + 7, F.lit(_PRIME))
    return F.pmod(x * 39_373 + 13, F.lit(_PRIME))


def smallest(df: DataFrame, keys: list[str], value: str, ties: list[str], k: Column | str, bins: int = BINS) -> DataFrame:
    """The k rows of each key with the smallest value (in 0 to 2^31 - 2), ties by the columns ties; k is constant within a key. Values are counted in bins;
    whole bins below the one in which the k-th falls are taken, and only that bin's rows are ranked."""
    rows = df.withColumn("__bin", F.floor(F.col(value) / math.ceil(_PRIME / bins)).cast("int")).withColumn("__k", F.col(k) if isinstance(k, str) else k)
    counts = rows.groupBy(*keys, "__bin").agg(F.count("*").alias("__c"))
    below = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__bin")) - F.col("__c")
    known = rows.join(counts.withColumn("__below", below).drop("__c"), [*keys, "__bin"])
    last = F.row_number().over(Window.partitionBy(*keys, "__bin").orderBy(value, *ties))
    counted = counts.withColumnRenamed("__c", "__size")
    known = known.join(counted, [*keys, "__bin"])
    whole = known.where(F.col("__below") + F.col("__size") <= F.col("__k"))
    cut = known.where((F.col("__below") < F.col("__k")) & (F.col("__below") + F.col("__size") > F.col("__k"))).withColumn("__r", last).where(F.col("__below") + F.col("__r") <= F.col("__k")).drop("__r")
    return whole.unionByName(cut).select(*df.columns)


def stratum_sizes(counts: dict, size: int) -> dict:
    """How many of size each stratum gets: its proportional share, the rest by the largest fractions, ties by stratum."""
    total = sum(counts.values())
    out = {s: size * c // total for s, c in counts.items()}
    rest = sorted(counts, key=lambda s: (-(size * counts[s] % total), s))
    for s in rest[: size - sum(out.values())]:
        out[s] += 1
    return out


def fixed_group_split(df: DataFrame, group: str, label: str, fraction: float, candidates: int = CANDIDATES, seed: int = 0, strict: bool = True) -> DataFrame:
    """group, partition, n, p: of seeded candidate draws the one whose validation part is nearest to the whole.

    Each draw takes exactly ceil(fraction x groups) groups (2 at least, 2 fewer than all at most), stratified by whether a group has any positive, without
    replacement. Its objective is |share of groups - fraction| + |share of rows - fraction| + 2 |prevalence - prevalence of all|, to 12 digits; ties go to the
    draw whose sorted groups come first. Groups are integers. Fewer than two groups with or without positives, or than four in all, are an error; unless
    strict is false: then a kind that is absent or alone is a stratum all the same, and of fewer than three groups none is held.
    """
    if not 0 < fraction < 1:
        raise ValueError("the fraction lies between 0 and 1")
    g = settled(totals(df, group, label), "totals")
    whole = {r["positive"]: (r["g"], r["n"], r["p"]) for r in g.groupBy("positive").agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("p").alias("p")).collect()}
    groups, rows, positives = (sum(v[i] for v in whole.values()) for i in range(3))
    if strict and (groups < 4 or min(whole.get(s, (0,))[0] for s in (False, True)) < 2):
        raise ValueError("a grouped split needs two groups with and two without positives")
    size = max(2, math.ceil(fraction * groups))
    size = groups - 2 if size >= groups else size
    if size < 1:
        return g.select("group", F.lit("train").alias("partition"), "n", "p")
    share = stratum_sizes({s: whole.get(s, (0,))[0] for s in (False, True)}, size)
    each = g.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    each = each.withColumn("h", draw(F.col("group"), F.col("candidate"), seed))
    held = settled(smallest(each, ["candidate", "positive"], "h", ["group"], F.when(F.col("positive"), share[True]).otherwise(share[False])), "draws")
    made = held.groupBy("candidate").agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("p").alias("p"))
    loss = F.abs(F.col("g") / groups - fraction) + F.abs(F.col("n") / rows - fraction) + 2 * F.abs(F.col("p") / F.col("n") - positives / rows)
    losses = [(r["candidate"], r["loss"]) for r in made.select("candidate", F.round(loss, 12).alias("loss")).collect()]  # one row a candidate
    best = sorted(c for c, x in losses if x == min(v for _, v in losses))
    while len(best) > 1:  # the smallest group that not all of them hold decides
        tied = held.where(F.col("candidate").isin(best)).groupBy("group").agg(F.sort_array(F.collect_set("candidate")).alias("c")).where(F.size("c") < len(best))
        first = tied.orderBy("group").limit(1).collect()
        best = list(first[0]["c"]) if first else best[:1]
    mine = held.where(F.col("candidate") == best[0]).select("group", F.lit(True).alias("held"))
    return g.join(mine, "group", "left").select("group", F.when(F.col("held"), "validation").otherwise("train").alias("partition"), "n", "p")


def greedy(groups: Iterator[tuple[int, int]], k: int, whole: tuple[int, int]) -> list[int]:
    """The fold of each (rows, positives), in the order given: where the spread of the folds' shares of negatives and positives becomes least,
    ties by the fewest rows, then the lowest fold."""
    held = np.zeros((k, 2))
    total = np.maximum(np.array([whole[0] - whole[1], whole[1]], float), 1)
    out = []
    for n, p in groups:
        mine = np.array([n - p, p], float)
        spread = []
        for f in range(k):
            held[f] += mine
            spread.append((round(float((held / total).std(axis=0).mean()), 12), held[f].sum() - n, f))
            held[f] -= mine
        best = min(spread)[2]
        held[best] += mine
        out.append(best)
    return out


def even_folds(g: DataFrame, keys: list[str], k: int, seed: int, block: int = BLOCK) -> DataFrame:
    """g (keys, group, n, p) with the fold of each group; each key is split for itself.

    Groups go to folds greedily, the most uneven first: by |negatives - positives| falling, then hash, then group. Up to block groups that is one greedy run,
    equal to a plain loop. More are dealt by hash to blocks that run side by side, each with folds of its own; the blocks' folds are then merged in turn
    largest first to the fold with the fewest rows, a block's folds to different ones. The last step handles groups / block x k totals of each key in one task.
    """
    kinds = {f.name: f.dataType for f in g.schema}
    names = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in keys)
    sep = ", " if keys else ""
    size = g.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("__blocks"), F.sum("n").alias("__n"), F.sum("p").alias("__p"))
    rows = g.join(F.broadcast(size), keys) if keys else g.crossJoin(F.broadcast(size))
    h = F.xxhash64(F.col("group").cast("string"), F.lit(seed))
    rows = rows.withColumn("__h", h).withColumn("__block", F.pmod(h, F.col("__blocks")))
    cols = [*keys, "__block", "group", "n", "p", "__h", "__n", "__p"]

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(__u=(part["n"] - 2 * part["p"]).abs()).sort_values(["__u", "__h", "group"], ascending=[False, True, True], kind="stable")
        part["fold"] = greedy(zip(part["n"], part["p"], strict=True), k, (int(part["n"].sum()), int(part["p"].sum())))
        return part[[*keys, "__block", "group", "n", "p", "fold"]]

    dealt = rows.select(*cols).groupBy(*keys, "__block").applyInPandas(deal, f"{names}{sep}__block long, group {kinds['group'].simpleString()}, n long, p long, fold int")
    dealt = settled(dealt, "dealt")

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        held, out = np.zeros((k, 2)), []
        first = part["__block"].min()
        for b, some in part.sort_values(["__block", "fold"]).groupby("__block", sort=True):
            free = list(range(k))
            for r in some.assign(__u=-some["n"]).sort_values(["__u", "fold"]).itertuples():
                f = r.fold if b == first else min(free, key=lambda f: (held[f].sum(), held[f][1], f))
                free.remove(f)
                held[f] += (r.n - r.p, r.p)
                out.append((*(getattr(r, c) for c in keys), b, r.fold, f))
        return pd.DataFrame(out, columns=[*keys, "__block", "fold", "merged"])

    cells = dealt.groupBy(*keys, "__block", "fold").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    moved = cells.groupBy(*keys).applyInPandas(merge, f"{names}{sep}__block long, fold int, merged int")
    return settled(dealt.join(moved, [*keys, "__block", "fold"]).select(*keys, "group", "n", "p", F.col("merged").alias("fold")), "folds")


def nested_group_folds(df: DataFrame, group: str, label: str, outer: int = 5, inner: int = 5, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """outer_fold, group, role, n, p: for each outer fold its groups as test, and of all others one inner fold as validation, the rest as train.

    Of the inner folds that one is validation whose |prevalence - that of train and validation| + 0.25 |share of rows - 1 / inner| is least, to 12 digits; ties
    by number. A role of an outer fold without both classes, or without rows, is an error.
    """
    g = settled(totals(df, group, label).select("group", "n", "p"), "totals")
    folds = even_folds(g, [], outer, seed, block)
    each = folds.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    test = each.where(F.col("fold") == F.col("outer_fold")).select("outer_fold", "group", F.lit("test").alias("role"), "n", "p")
    rest = even_folds(each.where(F.col("fold") != F.col("outer_fold")).select("outer_fold", "group", "n", "p"), ["outer_fold"], inner, seed + 1000, block)
    by_fold = rest.groupBy("outer_fold", "fold").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    whole = rest.groupBy("outer_fold").agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
    score = F.round(F.abs(F.col("p") / F.col("n") - F.col("all_p") / F.col("all_n")) + 0.25 * F.abs(F.col("n") / F.col("all_n") - 1 / inner), 12)
    best = by_fold.join(F.broadcast(whole), "outer_fold").groupBy("outer_fold").agg(F.min_by("fold", F.struct(score, "fold")).alias("chosen"))
    rest = rest.join(F.broadcast(best), "outer_fold").select("outer_fold", "group", F.when(F.col("fold") == F.col("chosen"), "validation").otherwise("train").alias("role"), "n", "p")
    out = test.unionByName(rest)
    sums = out.groupBy("outer_fold", "role").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).where("p > 0 AND p < n").groupBy().agg(F.count("*").alias("c"))
    if sums.first()["c"] != 3 * outer:
        raise ValueError("a role of an outer fold lacks one of the classes")
    return out


def limited_groups(g: DataFrame, limit: int | None) -> DataFrame:
    """g (group, n, p, positive) cut to limit groups for a trial run: the first with positives, the first without, then by group. No limit keeps all."""
    if limit is None:
        return g
    first = g.groupBy("positive").agg(F.min("group").alias("group")).withColumn("__first", F.when(F.col("positive"), 0).otherwise(1)).drop("positive")
    return g.join(F.broadcast(first), "group", "left").orderBy(F.coalesce("__first", F.lit(2)), "group").limit(max(1, limit)).drop("__first")


def fold_faults(assigned: DataFrame, rows: DataFrame, group: str, folds: int) -> DataFrame:
    """outer_fold, group, fault: groups with two roles in an outer fold (leak), and groups of rows that are not test exactly once (coverage, outer_fold null)."""
    leak = assigned.groupBy("outer_fold", "group").agg(F.count_distinct("role").alias("c")).where("c > 1").select("outer_fold", "group", F.lit("leak").alias("fault"))
    tests = assigned.where("role = 'test'").groupBy("group").agg(F.count("*").alias("c"))
    known = rows.select(F.col(group).alias("group")).where("group IS NOT NULL").distinct()
    miss = known.join(tests, "group", "full").where(F.coalesce("c", F.lit(0)) != 1).select(F.lit(None).cast("int").alias("outer_fold"), "group", F.lit("coverage").alias("fault"))
    return leak.unionByName(miss)
