"""Cluster bootstraps that follow one numpy stream, drawn side by side.

A generator's draws are one long sequence: replicate r of G groups has the draws r G to (r + 1) G - 1, and a later analysis goes on where an earlier one
stopped. The generator can jump to any of its 64-bit outputs, but a bounded draw may reject an output and take the next, so the place of a draw depends on all
rejections before it. Whether an output is rejected depends on that output alone. So blocks of outputs are first counted, each in its own task, and then drawn with
the number of draws before them known: the same numbers as one generator, with nothing but one count a block in the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.operators.bootstrap import replicate_metrics, replicate_rates
from evidra.operators.metrics import ranking
from evidra.sources.writers import settled

#: 64-bit outputs of a block: two 32-bit numbers each.
OUTPUTS = 1 << 19


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with i, its place from 0 in the order of the columns order (which tell all rows apart). Rows are sorted in ranges, and the ranges' sizes added."""
    ranged = settled(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))  # one row a range
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("__at", at).join(F.broadcast(before), "__part").withColumn("i", F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def outputs(seed: int, block: int, size: int) -> np.ndarray:
    """The 32-bit numbers of a block of the generator's outputs, the low half of each first."""
    bits = np.random.default_rng(seed).bit_generator
    bits.advance(block * size)
    raw = bits.random_raw(size)
    return np.stack([raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)], 1).ravel()


def bounded(numbers: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The draws below count that the numbers give, and which of them are taken."""
    wide = numbers * np.uint64(count)
    return (wide >> np.uint64(32)).astype(np.int64), (wide & np.uint64(0xFFFFFFFF)) >= np.uint64((2**32 - count) % count)


def draws(spark: SparkSession, count: int, replicates: int, seed: int, skip: int = 0, size: int = OUTPUTS) -> DataFrame:
    """replicate_id, i, w: how often each of count places is drawn in each replicate of count draws by default_rng(seed), after skip earlier draws of the
    same bound. One place is drawn without the generator, as numpy does."""
    if not 0 < count < 2**32:
        raise ValueError("there must be a group, and fewer than 2^32")
    if count == 1:
        return spark.range(replicates).select(F.col("id").alias("replicate_id"), F.lit(0).cast("long").alias("i"), F.lit(1).cast("long").alias("w"))
    last = skip + count * replicates
    share = 1 - ((2**32 - count) % count) / 2**32
    blocks = math.ceil((last / share + 8 * math.sqrt(last * (1 - share) / share**2) + 2) / (2 * size))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(bounded(outputs(seed, b, size), count)[1].sum()) for b in ids], pa.int64())], names=["block", "taken"])

    def each(n: int) -> DataFrame:
        return spark.range(0, n, 1, min(n, 1 << 14)).withColumnRenamed("id", "block")

    while True:
        taken = dict(map(tuple, each(blocks).mapInArrow(counted, "block long, taken long").collect()))
        if sum(taken.values()) >= last:
            break
        blocks += 1
    before = spark.sparkContext.broadcast(np.cumsum([0] + [taken[b] for b in range(blocks)]))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                value, ok = bounded(outputs(seed, b, size), count)
                value = value[ok]
                at = before.value[b] + np.arange(len(value)) - skip
                mine = (at >= 0) & (at < count * replicates)
                key, w = np.unique(at[mine] // count * count + value[mine], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key // count), pa.array(key % count), pa.array(w)], names=["replicate_id", "i", "w"])

    parts = each(blocks).mapInArrow(drawn, "replicate_id long, i long, w long")
    return parts.groupBy("replicate_id", "i").agg(F.sum("w").alias("w"))


def stream_multiplicities(groups: DataFrame, group: str, replicates: int, seed: int, order: str | None = None, skip: int = 0) -> DataFrame:
    """(replicate_id, group, w): draws over the distinct groups in sorted order or, with a column order, by where each is first seen. Null groups are
    left out. No groups, no draws."""
    some = groups.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(*([F.min(order).alias("__first")] if order else [F.count("*").alias("__first")]))
    placed = settled(numbered(some, ["__first", "group"] if order else ["group"]), "places")
    count = placed.count()
    if not count:
        return groups.sparkSession.createDataFrame([], f"replicate_id long, group {some.schema['group'].dataType.simpleString()}, w long")
    return draws(groups.sparkSession, count, replicates, seed, skip).join(placed, "i").select("replicate_id", "group", "w")


#: Metrics of a paired bootstrap in the order in which they take their draws.
PAIRED = ("F1", "Recall", "FPR", "MCC", "AUPRC")


def paired_cluster(rows: DataFrame, group: str, label: str, first: tuple[Column, str], second: tuple[Column, str], replicates: int, seed: int, metrics: tuple[str, ...] = PAIRED) -> DataFrame:
    """metric, difference_first_minus_second, ci95_lower, ci95_upper, probability_first_better of two systems, each (predicted, score column).

    Metric number m takes the draws after those of the metrics before it. Both systems share them. A replicate without positives, or without negatives, counts
    like any other: its rates are 0 by safe division, and so is its average precision. A lower FPR is better.
    """
    cells = {"F1": "f1", "Recall": "recall", "FPR": "fpr", "MCC": "mcc"}
    each = rows.select(F.col(group).alias("group"), (F.col(label) == 1).cast("int").alias("y"), *[c for k, (p, s) in enumerate((first, second)) for c in (p.alias(f"p{k}"), F.col(s).cast("double").alias(f"s{k}"))])
    long = each.select("group", "y", F.explode(F.array(*[F.struct(F.lit(k).alias("system"), F.col(f"p{k}").alias("p"), F.col(f"s{k}").alias("s")) for k in (0, 1)])).alias("x")).select("group", "y", "x.*")
    long = settled(long, "paired")
    w = settled(stream_multiplicities(long, "group", replicates * len(metrics), seed), "draws")
    number = F.floor(F.col("replicate_id") / replicates).cast("int")
    rates = replicate_rates(long, w.where(number.isin([i for i, m in enumerate(metrics) if m in cells])), "group", ["system"], "y", F.col("p")) if set(metrics) & set(cells) else None
    parts, points = [], []
    if rates is not None:
        value = F.coalesce(*[F.when(number == i, F.col(cells[m])) for i, m in enumerate(metrics) if m in cells])
        parts.append(rates.select("replicate_id", "system", value.alias("v")))
        whole = replicate_rates(long, long.select("group").distinct().select(F.lit(0).alias("replicate_id"), "group", F.lit(1).alias("w")), "group", ["system"], "y", F.col("p"))
        points += [whole.select(F.lit(m).alias("metric"), "system", F.col(cells[m]).alias("v")) for m in metrics if m in cells]
    for i, m in enumerate(metrics):
        if m == "AUPRC":
            ap = replicate_metrics(long, w.where(number == i), "group", ["system"], "y", "s")
            parts.append(ap.select("replicate_id", "system", F.when(F.col("positives") == F.col("n"), 1.0).otherwise(F.coalesce("average_precision", F.lit(0.0))).alias("v")))
            points.append(ranking(long, ["system"], "y", "s").select(F.lit(m).alias("metric"), "system", F.col("average_precision").alias("v")))
    united = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    sign = F.when(F.col("system") == 0, F.col("v")).otherwise(-F.col("v"))
    delta = united.groupBy("replicate_id").agg(F.sum(sign).alias("d")).withColumn("metric", F.element_at(F.array(*map(F.lit, metrics)), number + 1))
    better = F.avg(F.when(F.col("metric") == "FPR", F.col("d") < 0).otherwise(F.col("d") > 0).cast("double"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    out = delta.groupBy("metric").agg(q.alias("q"), better.alias("probability_first_better"))
    point = points[0]
    for x in points[1:]:
        point = point.unionByName(x)
    point = point.groupBy("metric").agg(F.sum(sign).alias("difference_first_minus_second"))
    return point.join(out, "metric").select("metric", "difference_first_minus_second", F.col("q")[0].alias("ci95_lower"), F.col("q")[1].alias("ci95_upper"), "probability_first_better")


def bucket_intervals(rows: DataFrame, bucket: str, group: str, label: str, score: str, replicates: int, seed: int, metric: str = "average_precision") -> DataFrame:
    """bucket, value, ci95_lower, ci95_upper, n_valid, n_one_class of a ranking metric in each bucket, over its own groups, each with a stream of its own.

    Replicates with one class are left out of the interval and counted; a bucket with no other has a null interval. Rows without a bucket are left
    out. Buckets are few, such as quantiles: each is a plan of its own.
    """
    rows = settled(rows.where(F.col(bucket).isNotNull() & F.col(group).isNotNull()), "buckets")
    out = None
    for b in [r[0] for r in rows.select(bucket).distinct().orderBy(bucket).collect()]:
        mine = rows.where(F.col(bucket) == F.lit(b)).withColumn("__one", F.lit(0))
        got = replicate_metrics(mine, stream_multiplicities(mine, group, replicates, seed), group, ["__one"], label, score)
        q = F.percentile(metric, F.array(F.lit(0.025), F.lit(0.975)))
        got = got.agg(q.alias("q"), F.count(metric).alias("n_valid"), F.sum((~F.col("valid")).cast("long")).alias("n_one_class"))
        got = ranking(mine, ["__one"], label, score).select(metric).crossJoin(F.broadcast(got))
        got = got.select(F.lit(b).alias(bucket), F.col(metric).alias("value"), F.col("q")[0].alias("ci95_lower"), F.col("q")[1].alias("ci95_upper"), "n_valid", "n_one_class")
        out = got if out is None else out.unionByName(got)
    if out is None:
        kind = rows.schema[bucket].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"{bucket} {kind}, value double, ci95_lower double, ci95_upper double, n_valid long, n_one_class long")
    return out
