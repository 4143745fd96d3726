"""Quality of translated corpora: alignment gates, pair flags, roll-ups, quality-stratified error analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import text as tx


def pair_flags(df: DataFrame, source: str, target: str, min_run: int = 4) -> DataFrame:
    """Length and repetition flags of text pairs, severity and the exclusion candidate flag. Repetition counts only as far as the target adds to
    that of its source; it is high from min_run equal units and two more than in the source."""
    m = tx.length_metrics(source, target)
    runs = {f"run_{u}": tx.longest_run(target, u) for u in (1, 2, 3)}
    src = {f"source_run_{u}": tx.longest_run(source, u) for u in (1, 2, 3)}
    out = df.select("*", *[v.alias(k) for k, v in (m | runs | src).items()])
    worst = F.greatest("run_1", "run_2", "run_3")
    theirs = F.greatest("source_run_1", "source_run_2", "source_run_3")
    excess = worst - theirs
    severity = F.when((worst < 2) | (excess <= 0), "none").when((worst >= min_run) & (excess >= 2), "high").when(worst >= 3, "medium").otherwise("low")
    out = out.withColumn("longest_run", worst).withColumn("repetition_excess", excess).withColumn("repetition", severity)
    out = out.withColumn("control_character_issue", tx.odd_controls(target))
    return out.withColumn("excluded", F.col("low_ratio") | F.col("high_ratio") | (F.col("repetition") == "high"))


def alignment_gate(source: DataFrame, target: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: rows on one side only, and mismatches of each field on both."""
    a = source.select(F.col(key), F.lit(1).alias("__a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    b = target.select(F.col(key), F.lit(1).alias("__b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    j = a.join(b, key, "full_outer")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return j.agg(n(F.col("__b").isNull()).alias("only_source"), n(F.col("__a").isNull()).alias("only_target"), *[n(both & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).alias(f"{f}_mismatch") for f in fields])


def strict_join(source: DataFrame, target: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The inner join on key, after the gate is all zero; else an error with the counts. Fields come from source."""
    gate = alignment_gate(source, target, key, fields).first().asDict()
    if any(gate.values()):
        raise ValueError(f"tables do not pair: {gate}")
    return source.join(target.drop(*fields), key)


def segments(df: DataFrame, key: str, parts: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """One row for each valid (role, source, target): long form of an example's text pairs."""
    rows = F.filter(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(i).alias("slot"), s.alias("source"), t.alias("target"), v.alias("valid")) for i, (r, s, t, v) in enumerate(parts)]), lambda x: x["valid"])
    return df.select(key, F.explode(rows).alias("x")).select(key, "x.role", "x.slot", "x.source", "x.target")


def roll_up(seg: DataFrame, key: str, score: str, flag: str) -> DataFrame:
    """Segment scores to examples: any flag, min, mean, max, the claim's own score, mean over the rest."""
    claim = F.col("role") == "claim"
    return seg.groupBy(key).agg(
        F.bool_or(flag).alias("any_flag"),
        F.min(score).alias("min_score"),
        F.avg(score).alias("mean_score"),
        F.max(score).alias("max_score"),
        F.max(F.when(claim, F.col(score))).alias("claim_score"),
        F.avg(F.when(~claim, F.col(score))).alias("rest_score"),
        F.count("*").alias("n_segments"),
    )


def quantile_buckets(df: DataFrame, value: str, k: int) -> DataFrame:
    """Right-closed buckets by distinct quantile edges; ties share a bucket."""
    edges = df.agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / k) for i in range(k + 1)]))).alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    return df.join(F.broadcast(edges)).withColumn("bucket", F.size(F.filter(inner, lambda e: e < F.col(value)))).drop("edges")


def filtered_steps(df: DataFrame, value: str, keep: list[str], steps: int = 21, upto: float = 0.9) -> DataFrame:
    """(step, keep, w): how many rows with these values pass each step's cut. The first cut keeps all, later ones drop a growing share of the lowest
    values. Cuts rise, so a row passes the first ones; rows are counted by how many before counts are set out by step."""
    shares = [upto * i / (steps - 1) for i in range(steps)]
    cuts = df.agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("q"), F.min(value).alias("low"))
    cuts = cuts.select(F.transform("q", lambda x, i: F.when(i == 0, F.col("low").cast("double") - 1).otherwise(x)).alias("cuts"))
    passed = F.size(F.filter("cuts", lambda c: c <= F.col(value)))
    counts = df.join(F.broadcast(cuts)).groupBy(*keep, passed.alias("passed")).agg(F.count("*").alias("w")).where("passed > 0")
    return counts.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("passed") - 1))).groupBy("step", *keep).agg(F.sum("w").alias("w"))


def average_ranks(df: DataFrame, keys: list[str], value: str, rank: str, bins: int = 256) -> DataFrame:
    """(keys, value, rank) of the distinct values: ties share the mean of their ranks. Values fall into bins by approximate percentiles of the key,
    sums run inside a bin, and bins' totals carry over, so that no key meets in one task."""
    edges = df.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(i / bins) for i in range(1, bins)]), F.lit(4 * bins)).alias("__edges"))
    at = df.groupBy(*keys, value).agg(F.count("*").alias("__n")).join(edges, keys)
    at = at.withColumn("__bin", F.size(F.filter("__edges", lambda e: e < F.col(value)))).drop("__edges")
    inside = Window.partitionBy(*keys, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("__upto", F.sum("__n").over(inside))
    totals = at.groupBy(*keys, "__bin").agg(F.sum("__n").alias("__all"))
    below = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__bin", F.coalesce(F.sum("__all").over(below), F.lit(0)).alias("__below"))
    return at.join(totals, [*keys, "__bin"]).select(*keys, value, (F.col("__below") + F.col("__upto") - (F.col("__n") - 1) / 2).alias(rank))


def correlations(df: DataFrame, signals: list[str], target: str) -> DataFrame:
    """Pearson and Spearman of each signal with the target, for signals of at least three rows that vary."""
    long = df.select(F.col(target).cast("double").alias("t"), *[F.col(s).cast("double").alias(s) for s in signals]).unpivot("t", signals, "signal", "v").where("v IS NOT NULL AND t IS NOT NULL")
    ranked = long.join(average_ranks(long, ["signal"], "t", "rt"), ["signal", "t"]).join(average_ranks(long, ["signal"], "v", "rv"), ["signal", "v"])
    got = ranked.groupBy("signal").agg(F.count("*").alias("n"), F.corr("v", "t").alias("pearson"), F.corr("rv", "rt").alias("spearman"), F.stddev_pop("v").alias("sv"), F.stddev_pop("t").alias("st"))
    return got.where("n >= 3 AND sv > 0 AND st > 0").drop("sv", "st")


def error_model(df: DataFrame, target: str, features: list[str], ridge: float = 1e-3) -> DataFrame:
    """Logistic regression of a 0/1 target on standardised features, rows with a null left out: feature, coefficient; the intercept, too. Needs three
    rows and both classes, else no row."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = df.select(F.col(target).cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    spark, schema = df.sparkSession, "feature string, coefficient double"
    n = rows.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    if n["n"] < 3 or n["p"] in (0, n["n"]):
        return spark.createDataFrame([], schema)
    raw = VectorAssembler(inputCols=features, outputCol="raw").transform(rows)
    x = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(raw).transform(raw)
    m = LogisticRegression(featuresCol="x", regParam=ridge, maxIter=100, tol=1e-10, standardization=False).fit(x)
    return spark.createDataFrame([*zip(features, m.coefficients.toArray().tolist(), strict=True), ("intercept", float(m.intercept))], schema)


def logistic_fit(df: DataFrame, target: str, features: list[str], c: float = 1.0, steps: int = 100, tol: float = 1e-9) -> DataFrame:
    """Logistic regression of a 0/1 target on the features as they are, with the penalty |w|^2 / 2 against c times the summed loss and a free intercept:
    feature, coefficient; the intercept, too. Rows with a null or NaN are left out; one class gives no row. Newton's method: equal rows are folded once, each
    step is one aggregate of the loss, its gradient and curvature (as many numbers as features squared), halved while the loss would rise."""
    import numpy as np

    from evidra.sources.writers import settled

    d, spark = len(features), df.sparkSession
    x = [F.col(f"x{i}") for i in range(d)] + [F.lit(1.0)]
    rows = df.select(F.col(target).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).dropna()
    folded = settled(rows.groupBy(*[f"x{i}" for i in range(d)]).agg(F.count("*").alias("n"), F.sum("y").alias("pos")), "logistic")
    total = folded.agg(F.sum("n").alias("n"), F.sum("pos").alias("p")).first()
    if not total["n"] or total["p"] in (0, total["n"]):
        return spark.createDataFrame([], "feature string, coefficient double")
    ridge = np.diag([1.0 / c] * d + [0.0])

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((F.lit(float(b)) * v for b, v in zip(w, x, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        loss = F.col("n") * (F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0))) - F.col("pos") * z
        curve = F.col("n") * p * (1 - p)
        got = folded.agg(F.sum(loss), *[F.sum((F.col("n") * p - F.col("pos")) * v) for v in x], *[F.sum(curve * x[i] * x[j]) for i in range(d + 1) for j in range(i + 1)]).first()
        h, rest = np.zeros((d + 1, d + 1)), iter(got[d + 2 :])
        for i in range(d + 1):
            for j in range(i + 1):
                h[i, j] = h[j, i] = next(rest)
        return got[0] + w @ ridge @ w / 2, np.array(got[1 : d + 2]) + ridge @ w, h + ridge

    w = np.zeros(d + 1)
    loss, slope, curve = at(w)
    for _ in range(steps):
        step = np.linalg.lstsq(curve, slope, rcond=None)[0]
        if slope @ step <= tol * (1 + abs(loss)):
            w = w - step
            break
        new = at(w - step)
        while new[0] > loss and np.abs(step).max() > 1e-12:
            step = step / 2
            new = at(w - step)
        w, (loss, slope, curve) = w - step, new
    return spark.createDataFrame([*zip(features, map(float, w[:d]), strict=True), ("intercept", float(w[d]))], "feature string, coefficient double")


def order_breaks(rows: DataFrame, source: str, output: str, size: int = 100_000) -> DataFrame:
    """n and out_of_order: rows whose source position is not above that of the row before them by output position. Neighbours meet
    inside ranges of output positions; the last row of a range is carried over to the next range that has rows."""
    part = rows.select(F.floor(F.col(output) / size).alias("part"), F.col(output).alias("o"), F.col(source).alias("s"))
    inside = part.withColumn("before", F.lag("s").over(Window.partitionBy("part").orderBy("o", "s")))
    totals = inside.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("s") <= F.col("before")).alias("bad"), F.min(F.struct("o", "s")).alias("first"), F.max(F.struct("o", "s")).alias("last"))
    carried = totals.withColumn("before", F.lag("last.s").over(Window.partitionBy(F.lit(0)).orderBy("part")))
    bad = F.col("bad") + F.when(F.col("first.s") <= F.col("before"), 1).otherwise(0)
    return carried.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(bad), F.lit(0)).alias("out_of_order"))
