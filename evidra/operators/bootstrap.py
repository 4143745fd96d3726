"""Cluster bootstrap with multiplicities that all conditions and seeds share.

A replicate draws as many groups as there are, with replacement. Draws are a table (replicate, group, w); rows are never repeated, they are weighted. Ranking
metrics work on scores pre-aggregated by group; thresholded ones on confusion counts by group, so replicates cost groups, not rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.operators.metrics import ranking, rates


def multiplicities(groups: DataFrame, group: str, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate_id, group, w) by a linear congruence of replicate and draw that any SQL engine can follow."""
    dense = groups.select(F.col(group).alias("group")).distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("group")) - 1)
    n = dense.agg(F.count("*").cast("long").alias("G"))
    each = n.first()["G"]
    draws = groups.sparkSession.range(replicates * each).select(F.floor(F.col("id") / max(each, 1)).alias("replicate_id"), F.pmod("id", F.lit(max(each, 1))).alias("d"), F.lit(each).alias("G"))
    x = F.pmod(F.col("replicate_id") * 1_000_003 + F.col("d") * 7_919 + seed * 104_729 + 12_345, F.lit(2_147_483_647))
    x = F.pmod(x * 48_271 + 11, F.lit(2_147_483_647))
    x = F.pmod(x * 69_621 + 7, F.lit(2_147_483_647))
    draws = draws.select("replicate_id", F.pmod(F.floor(x / 128).cast("long"), F.col("G")).alias("i"))
    w = draws.groupBy("replicate_id", "i").agg(F.count("*").alias("w"))
    return w.join(dense, "i").select("replicate_id", "group", "w")


def numpy_multiplicities(spark: SparkSession, groups: list[str], replicates: int, seed: int, protocol: str = "integers") -> DataFrame:
    """The same table with a numpy generator: `integers` over sorted groups, `choice` over sorted or `choice_seen` over groups as given.
    Groups times replicates are drawn on the driver; both are set by configuration."""
    order = list(dict.fromkeys(groups)) if protocol == "choice_seen" else sorted(set(groups))
    rng = np.random.default_rng(seed)
    rows = []
    for r in range(replicates):
        at = rng.integers(0, len(order), len(order)) if protocol == "integers" else rng.choice(len(order), len(order), replace=True)
        counts = np.bincount(at, minlength=len(order))
        rows += [(r, order[i], int(counts[i])) for i in np.flatnonzero(counts)]
    return spark.createDataFrame(rows, "replicate_id long, group string, w long")


#: Replicates whose weights meet in one task, and weights of rows that it holds at once.
CHUNK, HELD = 250, 2_000_000


def replicate_metrics_matrix(rows: DataFrame, draws: DataFrame, group: str, keys: list[str], label: str, score: str) -> DataFrame:
    """replicate_metrics by matrices: a task takes a key's counts by group, score and label and the weights of CHUNK replicates. For evaluation
    sets whose counts of one key fit in a task (some million); any other goes through replicate_metrics."""
    folded = rows.groupBy(F.col(group).alias("group"), *keys, F.col(score).cast("double").alias("score")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.count("*").alias("n"))
    parts = draws.select(F.floor(F.col("replicate_id") / CHUNK).alias("part")).distinct()
    left = folded.join(parts)
    right = draws.withColumn("part", F.floor(F.col("replicate_id") / CHUNK)).join(folded.select(*keys).distinct())
    kinds = {f.name: f.dataType.simpleString() for f in folded.schema}
    names = [*keys, "replicate_id", "average_precision", "auroc", "brier", "n", "positives"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", replicate_id long, average_precision double, auroc double, brier double, n long, positives long"

    def one(key: tuple, counts: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        if not len(counts) or not len(weights):
            return pd.DataFrame({c: [] for c in names})
        counts = counts.sort_values(["score", "group"], ascending=[False, True], kind="stable")
        where = {g: i for i, g in enumerate(sorted(set(counts["group"])))}
        at = counts["group"].map(where).to_numpy()
        s, pos, n = (counts[c].to_numpy(float) for c in ("score", "pos", "n"))
        reps = np.array(sorted(set(weights["replicate_id"])))
        w = np.zeros((len(reps), len(where)))
        known = weights[weights["group"].isin(where)]
        w[np.searchsorted(reps, known["replicate_id"].to_numpy()), known["group"].map(where).to_numpy(int)] = known["w"].to_numpy()
        edge = np.flatnonzero(np.append(s[1:] != s[:-1], True))
        first = np.concatenate([[0], edge[:-1] + 1])
        out = []
        step = max(1, HELD // len(s))
        for a in range(0, len(reps), step):
            each = w[a : a + step][:, at]
            p, all_ = np.add.reduceat(each * pos, first, axis=1), np.add.reduceat(each * n, first, axis=1)
            cp, ca = p.cumsum(1), all_.cumsum(1)
            P, T = cp[:, -1], ca[:, -1]
            with np.errstate(divide="ignore", invalid="ignore"):
                ap = np.nansum(p / P[:, None] * np.where(ca > 0, cp / ca, 0), axis=1)
                auroc = ((all_ - p) * (cp - p / 2)).sum(1) / (P * (T - P))
                brier = ((p * (s[edge] - 1) ** 2) + (all_ - p) * s[edge] ** 2).sum(1) / T
            out.append(pd.DataFrame({"replicate_id": reps[a : a + step], "average_precision": ap, "auroc": auroc, "brier": brier, "n": T.astype(int), "positives": P.astype(int)}))
        got = pd.concat(out)
        got = got[got["n"] > 0]
        for c, v in zip(keys, key, strict=False):
            got[c] = v
        return got[names]

    left, right = (x.toDF(*x.columns) for x in (left, right))  # names of their own: both sides come from folded
    got = left.groupBy(*keys, "part").cogroup(right.groupBy(*keys, "part")).applyInPandas(one, schema)
    valid = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    return got.select("replicate_id", *keys, *[F.when(valid, F.col(m)).alias(m) for m in ("average_precision", "auroc", "brier")], valid.alias("valid"), "n", "positives")


def replicate_metrics(rows: DataFrame, draws: DataFrame, group: str, keys: list[str], label: str, score: str) -> DataFrame:
    """Ranking metrics of each (replicate, key); replicates with one class are kept with valid = false and null metrics."""
    folded = rows.groupBy(F.col(group).alias("group"), *keys, F.col(score).alias("score"), F.col(label).alias("y")).agg(F.count("*").alias("c"))
    joined = folded.join(draws, "group")
    got = ranking(joined, ["replicate_id", *keys], "y", "score", F.col("w") * F.col("c"))
    valid = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    return got.select("replicate_id", *keys, *[F.when(valid, F.col(m)).alias(m) for m in ("average_precision", "auroc", "brier")], valid.alias("valid"), "n", "positives")


def replicate_rates(rows: DataFrame, draws: DataFrame, group: str, keys: list[str], label: str, predicted: Column) -> DataFrame:
    """Thresholded metrics of each (replicate, key) from confusion counts by group."""
    y = F.col(label) == 1
    cells = {"tp": y & predicted, "fp": ~y & predicted, "tn": ~y & ~predicted, "fn": y & ~predicted}
    by_group = rows.groupBy(F.col(group).alias("group"), *keys).agg(*[F.sum(c.cast("long")).alias(k) for k, c in cells.items()])
    got = by_group.join(draws, "group").groupBy("replicate_id", *keys).agg(*[F.sum(F.col(k) * F.col("w")).alias(k) for k in cells])
    return got.select("replicate_id", *keys, *cells, *[v.alias(k) for k, v in rates().items()])


def melted(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(keys, metrics, "metric", "value")


def contrasts(values: DataFrame, keys: list[str], condition: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """delta = b - a of conditions for each key, for each named pair (a, b): one pivot, no self-joins."""
    names = sorted({c for p in pairs.values() for c in p})
    wide = values.groupBy(*keys).pivot(condition, names).agg(F.first("value"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("contrast"), (F.col(f"`{b}`") - F.col(f"`{a}`")).alias("delta")) for k, (a, b) in pairs.items()]))
    return wide.select(*keys, rows.alias("x")).select(*keys, "x.contrast", "x.delta")


def interactions(deltas: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Differences of contrasts: delta of the first less delta of the second."""
    d = deltas.withColumnRenamed("delta", "value")
    return contrasts(d, keys, "contrast", {k: (second, first) for k, (first, second) in pairs.items()}).withColumnRenamed("contrast", "interaction")


def summary(deltas: DataFrame, keys: list[str], value: str = "delta", confidence: float = 0.95) -> DataFrame:
    """mean, median, percentile interval, shares above and below 0, count; nulls left out."""
    a = (1 - confidence) / 2
    ok = deltas.where(F.col(value).isNotNull())
    q = F.percentile(value, F.array(F.lit(a), F.lit(0.5), F.lit(1 - a)))
    got = ok.groupBy(*keys).agg(F.avg(value).alias("mean"), q.alias("q"), F.avg((F.col(value) > 0).cast("double")).alias("p_positive"), F.avg((F.col(value) < 0).cast("double")).alias("p_negative"), F.count("*").alias("n_valid"))
    return got.select(*keys, "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("ci_low"), F.col("q")[2].alias("ci_high"), "p_positive", "p_negative", "n_valid")


#: Metrics that are better when lower, and families of contrasts that state a sign instead of a side.
LOWER_BETTER = ("brier", "fpr")
INTERACTIONS = ("translation_interaction", "set_effect_interaction")


def verdict(metric: str | Column = "metric", low: str = "ci_low", high: str = "ci_high", family: Column | None = None) -> Column:
    """FAVOR_B or FAVOR_A if the interval of b - a leaves out 0, by the metric's direction; POSITIVE or NEGATIVE for interactions; else INCONCLUSIVE."""
    m = F.col(metric) if isinstance(metric, str) else metric
    up, down = F.col(low) > 0, F.col(high) < 0
    side = F.when((up & ~m.isin(*LOWER_BETTER)) | (down & m.isin(*LOWER_BETTER)), "FAVOR_B").when(up | down, "FAVOR_A").otherwise("INCONCLUSIVE")
    if family is None:
        return side
    sign = F.when(down, "NEGATIVE").when(up, "POSITIVE").otherwise("INCONCLUSIVE")
    return F.when(family.isin(*INTERACTIONS), sign).otherwise(side)
