"""Classification metrics, ranking metrics and thresholds over long tables.

Ordered sums never gather a key in one task: scores in [0, 1] fall into BINS, sums run inside a bin, and bins' totals (at most BINS rows a
key) give what lies above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.scalars import ABOVE_ONE, clip, safe_divide

BINS = 1024


def rates(tp: str | Column = "tp", fp: str | Column = "fp", tn: str | Column = "tn", fn: str | Column = "fn") -> dict[str, Column]:
    """Metrics of a confusion matrix; every undefined one is 0."""
    tp, fp, tn, fn = ((F.col(x) if isinstance(x, str) else x).cast("double") for x in (tp, fp, tn, fn))
    recall, spec = safe_divide(tp, tp + fn), safe_divide(tn, tn + fp)
    return {
        "precision": safe_divide(tp, tp + fp),
        "recall": recall,
        "f1": safe_divide(2 * tp, 2 * tp + fp + fn),
        "accuracy": safe_divide(tp + tn, tp + fp + tn + fn),
        "balanced_accuracy": (recall + spec) / 2,
        "mcc": safe_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "fpr": safe_divide(fp, fp + tn),
        "specificity": spec,
    }


def confusion(df: DataFrame, keys: list[str], label: str, predicted: Column, weight: Column | None = None) -> DataFrame:
    """Counts tp, fp, tn, fn and rates for each key."""
    w = F.lit(1) if weight is None else weight
    y, p = F.col(label) == 1, predicted
    cells = {"tp": y & p, "fp": ~y & p, "tn": ~y & ~p, "fn": y & ~p}
    got = df.groupBy(*keys).agg(*[F.sum(F.when(c, w).otherwise(0)).cast("long").alias(k) for k, c in cells.items()])
    return got.select(*keys, *cells, *[v.alias(k) for k, v in rates().items()])


def by_score(df: DataFrame, keys: list[str], label: str, score: str, weight: Column | None = None) -> DataFrame:
    """For each key and distinct score: pos and n there (at), and at or above it (cum), and of the whole key (all)."""
    w = F.lit(1) if weight is None else weight
    at = df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(w * F.col(label)).alias("pos"), F.sum(w).alias("n")).where("n > 0")
    at = at.withColumn("bin", F.floor(clip("score") * BINS).cast("int"))
    inside = Window.partitionBy(*keys, "bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("cpos", F.sum("pos").over(inside)).withColumn("cn", F.sum("n").over(inside))
    totals = at.groupBy(*keys, "bin").agg(F.sum("pos").alias("bpos"), F.sum("n").alias("bn"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    above = by_key.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "bin", F.coalesce(F.sum("bpos").over(above), F.lit(0)).alias("apos"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"), F.sum("bpos").over(by_key).alias("P"), F.sum("bn").over(by_key).alias("T"))
    out = at.join(totals, [*keys, "bin"])
    return out.select(*keys, "score", "pos", "n", (F.col("cpos") + F.col("apos")).alias("cum_pos"), (F.col("cn") + F.col("an")).alias("cum_n"), F.col("P").alias("all_pos"), F.col("T").alias("all_n"))


def ranking(df: DataFrame, keys: list[str], label: str, score: str, weight: Column | None = None) -> DataFrame:
    """average_precision (ties as one step), auroc (ties count half, null for one class) and brier for each key."""
    s = by_score(df, keys, label, score, weight)
    neg = F.col("n") - F.col("pos")
    P, N = F.col("all_pos").cast("double"), (F.col("all_n") - F.col("all_pos")).cast("double")
    return s.groupBy(*keys).agg(
        F.sum(safe_divide(F.col("pos"), P) * safe_divide("cum_pos", "cum_n")).alias("average_precision"),
        F.sum(F.try_divide(neg * (F.col("cum_pos") - F.col("pos") / 2), P * N)).alias("auroc"),
        safe_divide(F.sum(F.col("pos") * F.pow(F.col("score") - 1, F.lit(2)) + neg * F.pow("score", F.lit(2))), F.sum("n")).alias("brier"),
        F.sum("n").alias("n"),
        F.sum("pos").alias("positives"),
    )


def operating_points(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Counts and rates for each threshold candidate: distinct scores, 0, 1 and the least double above 1."""
    extra = df.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(x) for x in (0.0, 1.0, ABOVE_ONE)])).alias("score"), F.lit(0).alias("y"), F.lit(0).alias("w"))
    rows = df.select(*keys, F.col(score).cast("double").alias("score"), F.col(label).alias("y"), F.lit(1).alias("w")).unionAll(extra)
    at = rows.groupBy(*keys, "score").agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum("w").alias("n"))
    at = at.withColumn("bin", F.floor(clip("score", 0.0, ABOVE_ONE) * BINS).cast("int") + F.when(F.col("score") > 1, 1).otherwise(0))
    inside = Window.partitionBy(*keys, "bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("cpos", F.sum("pos").over(inside)).withColumn("cn", F.sum("n").over(inside))
    totals = at.groupBy(*keys, "bin").agg(F.sum("pos").alias("bpos"), F.sum("n").alias("bn"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    above = by_key.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "bin", F.coalesce(F.sum("bpos").over(above), F.lit(0)).alias("apos"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"), F.sum("bpos").over(by_key).alias("P"), F.sum("bn").over(by_key).alias("T"))
    got = at.join(totals, [*keys, "bin"])
    tp, p = F.col("cpos") + F.col("apos"), F.col("cn") + F.col("an")
    got = got.select(*keys, F.col("score").alias("threshold"), tp.alias("tp"), (p - tp).alias("fp"), (F.col("T") - F.col("P") - p + tp).alias("tn"), (F.col("P") - tp).alias("fn"))
    return got.select("*", *[v.alias(k) for k, v in rates().items()])


def select_threshold(points: DataFrame, keys: list[str], rule: str, max_fpr: float = 0.10) -> DataFrame:
    """The chosen operating point of each key.

    f1: best F1, then recall, lower FPR, higher threshold. fpr: of points with FPR within max_fpr the best recall, then
    F1, lower FPR, lower threshold. operational: best recall, lower FPR, higher threshold, within max_fpr. max_f1: best F1, higher threshold.
    """
    t = F.col("threshold")
    order = {
        "f1": [F.col("f1"), F.col("recall"), -F.col("fpr"), t],
        "fpr": [F.col("recall"), F.col("f1"), -F.col("fpr"), -t],
        "operational": [F.col("recall"), -F.col("fpr"), t],
        "max_f1": [F.col("f1"), t],
    }[rule]
    ok = points.where(F.col("fpr") <= max_fpr + 1e-12) if rule in ("fpr", "operational") else points
    cols = [c for c in points.columns if c not in keys]
    rank = F.struct(*[x.alias(f"o{i}") for i, x in enumerate(order)])
    return ok.groupBy(*keys).agg(F.max_by(F.struct(*cols), rank).alias("best")).select(*keys, "best.*")


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, sample std, min, quartile-like percentiles and max; zeros for what is undefined."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.5, 0.75, 0.9, 0.95)]))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    got = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).cast("double").alias("min"), q.alias("q"), F.max(value).cast("double").alias("max"))
    return got.select(*keys, "n", *[z(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")], *[z(F.col("q")[i]).alias(k) for i, k in enumerate(("p50", "p75", "p90", "p95"))])


def cohen_d(df: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """Standardised difference of means between label 1 and 0; 0 where undefined."""
    y = F.col(label) == 1
    agg = {}
    for k, c in (("p", y), ("q", ~y)):
        v = F.when(c, F.col(value).cast("double"))
        agg |= {f"n{k}": F.count(v), f"m{k}": F.avg(v), f"v{k}": F.coalesce(F.var_samp(v), F.lit(0.0))}
    got = df.groupBy(*keys).agg(*[v.alias(k) for k, v in agg.items()])
    pooled = F.sqrt(safe_divide((F.col("np") - 1) * F.col("vp") + (F.col("nq") - 1) * F.col("vq"), F.col("np") + F.col("nq") - 2))
    return got.select(*keys, safe_divide(F.col("mp") - F.col("mq"), pooled).alias("cohen_d"))
