"""Training views: duplicate groups, decisions, representatives, leaks, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.scalars import safe_divide, same_float
from evidra.functions.text import sha_key


def duplicate_groups(df: DataFrame, source: str, claim: str, label: str) -> DataFrame:
    """One row for each (source, claim): id, size, label set, conflict."""
    g = df.groupBy(F.col(source).alias("source"), F.col(claim).alias("claim")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(label)).alias("labels"))
    return g.select("source", "claim", sha_key("source", "claim").alias("duplicate_group_id"), "n", "labels", (F.size("labels") > 1).alias("conflict"))


def input_differences(df: DataFrame, keys: list[str], order: str, exact: list[str], close: list[str]) -> DataFrame:
    """For each key, the names of fields in which a row differs from the group's first row (by order)."""
    fields = exact + close
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("__f"))
    rows = df.join(first, keys)
    tests = [F.when(~F.col(c).eqNullSafe(F.col("__f")[c]), F.lit(c)) for c in exact] + [F.when(~same_float(F.col(c).cast("double"), F.col("__f")[c].cast("double")), F.lit(c)) for c in close]
    return rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array(*tests)))))).alias("differences"))


def decisions(groups: DataFrame, differences: DataFrame, keys: list[str]) -> DataFrame:
    """drop_conflict before drop_input_mismatch before collapse before singleton."""
    d = groups.join(differences, keys, "left")
    mismatch = F.size(F.coalesce("differences", F.array().cast("array<string>"))) > 0
    return d.withColumn("decision", F.when(F.col("conflict"), "drop_conflict").when(mismatch, "drop_input_mismatch").when(F.col("n") > 1, "collapse").otherwise("singleton"))


def representatives(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. As an aggregate of structs, so that a hot key folds before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def group_leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that occur in more than one split."""
    return df.groupBy(group).agg(F.sort_array(F.collect_set(split)).alias("splits"), F.count("*").alias("n")).where(F.size("splits") > 1)


def bucket(key: str | Column, n: int, seed: int = 0) -> Column:
    """A reproducible bucket of an integer key, computable in any engine: linear congruence, high part taken."""
    k = F.col(key) if isinstance(key, str) else key
    x = F.pmod(k.cast("long") * 48271 + F.lit(seed * 7919 + 11).cast("long"), F.lit(2147483647))
    return F.pmod(F.floor(x / 7).cast("long"), F.lit(n))


def stratified_sample(df: DataFrame, strata: list[str], id_col: str, k: int, seed: int = 0) -> DataFrame:
    """One row of each stratum, then rows in hashed order up to k in all."""
    h = bucket(id_col, 1_000_003, seed)
    r = F.row_number().over(Window.partitionBy(*strata).orderBy(h, id_col))
    return df.withColumn("__h", h).withColumn("stratum_rank", r).orderBy((F.col("stratum_rank") > 1).cast("int"), "__h", id_col).limit(k).drop("__h")


def round_robin_sample(df: DataFrame, strata: list[str], id_col: str, k: int, seed: int = 0) -> DataFrame:
    """k rows, one of each stratum in turn, strata in order, rows of a stratum in hashed order; used-up strata are passed over."""
    h = bucket(id_col, 1_000_003, seed)
    r = F.row_number().over(Window.partitionBy(*strata).orderBy(h, id_col))
    return df.withColumn("stratum_rank", r).where(F.col("stratum_rank") <= k).orderBy("stratum_rank", *strata).limit(k)


def stratified_group_split(groups: DataFrame, group: str, strata: list[str], fraction: float, fallback: list[str] | None = None, seed: int = 0) -> DataFrame:
    """(group, partition) of one row a group: of each stratum the share fraction, rounded, in hashed order, is for validation. If a stratum has
    fewer than two groups, fallback (a part of strata) is used for all. Groups are integers, or what bucket takes."""
    least = groups.groupBy(*strata).agg(F.count("*").alias("n")).agg(F.min("n").alias("n")).first()["n"]
    by = strata if least is None or least >= 2 or fallback is None else fallback
    w = Window.partitionBy(*by)
    h = bucket(group, 1_000_003, seed)
    r, n = F.row_number().over(w.orderBy(h, group)), F.count("*").over(w)
    return groups.select(group, *strata, F.when(r <= F.round(n * F.lit(fraction)), "validation").otherwise("train").alias("partition"))


def nested_folds(df: DataFrame, group: str, label: str, outer: int = 5, inner: int = 5, seed: int = 0) -> DataFrame:
    """(outer, group, role, inner): for each outer fold its groups as test and all others with an inner fold of their own, both even in
    positives and size. Works on group totals."""
    folds = k_folds(df, group, label, outer, seed)
    each = folds.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    test = each.where(F.col("fold") == F.col("outer")).select("outer", "group", F.lit("test").alias("role"), F.lit(-1).alias("inner"), "n", "p")
    i = F.row_number().over(Window.partitionBy("outer").orderBy(F.desc("p"), F.desc("n"), F.xxhash64(F.col("group").cast("string"), F.lit(seed + 1)), "group")) - 1
    train = each.where(F.col("fold") != F.col("outer")).select("outer", "group", F.lit("train").alias("role"), _snake(i, inner).alias("inner"), "n", "p")
    return test.unionAll(train)


def _snake(i: Column, k: int) -> Column:
    """0, 1, ... k - 1, k - 1, ... 1, 0, 0, 1, ..."""
    at = F.pmod(i, F.lit(k))
    return F.when(F.pmod(F.floor(i / k), F.lit(2)) == 0, at).otherwise(k - 1 - at).cast("int")


def context(text: Column | str, start: Column | str, end: Column | str, width: int = 180) -> Column:
    """The text from width characters before start to width after end."""
    text, start, end = (F.col(x) if isinstance(x, str) else x for x in (text, start, end))
    low = F.greatest(F.lit(0), start - width)
    return F.substring(text, low + 1, end + width - low)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def grouped_split(df: DataFrame, group: str, label: str, fraction: float, candidates: int = 128, seed: int = 0) -> DataFrame:
    """(group, partition): of seeded candidate splits by group the one whose validation part is nearest to the fraction in groups and rows
    and to the whole in prevalence (twice the weight); ties by candidate. Works on group totals, one row a group and candidate."""
    stats = df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    total = stats.agg(F.count("*").alias("all_g"), F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
    cand = stats.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    draw = F.pmod(F.xxhash64(F.col("group").cast("string"), F.col("candidate"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    cand = cand.withColumn("held", draw < fraction)
    score = cand.groupBy("candidate").agg(*[F.sum(F.when(F.col("held"), F.lit(v) if isinstance(v, int) else F.col(v)).otherwise(0)).alias(k) for k, v in (("g", 1), ("hn", "n"), ("hp", "p"))]).join(F.broadcast(total))
    loss = F.abs(F.col("g") / F.col("all_g") - fraction) + F.abs(F.col("hn") / F.col("all_n") - fraction) + 2 * F.abs(safe_divide("hp", "hn") - safe_divide("all_p", "all_n"))
    best = score.where("hn > 0").agg(F.min_by("candidate", F.struct(loss.alias("l"), F.col("candidate"))).alias("candidate"))
    return cand.join(F.broadcast(best), "candidate").select("group", F.when(F.col("held"), "validation").otherwise("train").alias("partition"), "n", "p")


def k_folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """(group, fold): groups in snake order of positives and size, so that folds are even in both."""
    stats = df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("p"), F.desc("n"), F.xxhash64(F.col("group").cast("string"), F.lit(seed)), "group")
    return stats.select("group", _snake(F.row_number().over(order) - 1, k).alias("fold"), "n", "p")
