"""Results held against stored ones: cells that differ beyond a tolerance, and decisions made out of fold with frozen thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators import metrics as me

#: Rules of thresholds chosen on the validation part of a fold.
RULES = {"max_f1": "max_f1", "operational": "operational"}
#: Cells that an error names; the table of cells has all.
NAMED = 50


def cells(observed: DataFrame, stored: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """One row for each key and metric: observed, stored, and fault. fault is null if they are within the metric's absolute tolerance or both null or NaN;
    differs; missing (no stored row); extra (no observed row); or ambiguous (a side has the key more than once). Null keys equal each other."""

    def long(df: DataFrame, side: str) -> DataFrame:
        values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in tolerances]))
        return df.select(*keys, values.alias("x")).groupBy(*keys, "x.metric").agg(F.count("*").alias(f"__{side}"), F.first("x.v").alias(side))

    a, b = long(observed, "observed").alias("a"), long(stored, "stored").alias("b")
    both = [*keys, "metric"]
    same = F.lit(True)
    for k in both:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    j = a.join(b, same, "full").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in both], "observed", "stored", "__observed", "__stored")
    limit = F.element_at(F.create_map(*[F.lit(x) for m, t in tolerances.items() for x in (m, float(t))]), F.col("metric"))
    none = [F.col(c).isNull() | F.isnan(c) for c in ("observed", "stored")]
    near = F.when(none[0] | none[1], none[0] & none[1]).otherwise((F.col("observed") == F.col("stored")) | (F.abs(F.col("observed") - F.col("stored")) <= limit))
    fault = F.when(F.col("__stored").isNull(), "missing").when(F.col("__observed").isNull(), "extra").when((F.col("__observed") > 1) | (F.col("__stored") > 1), "ambiguous").when(~near, "differs")
    return j.select(*both, "observed", "stored", fault.alias("fault"))


def require_reproduced(observed: DataFrame, stored: DataFrame, keys: list[str], tolerances: dict[str, float], what: str = "metrics") -> DataFrame:
    """observed, unless any cell is off: then a ValueError with how many are and the first of them."""
    off = cells(observed, stored, keys, tolerances).where("fault IS NOT NULL")
    n = off.groupBy("fault").count().collect()
    if n:
        first = [tuple(r) for r in off.orderBy(*keys, "metric").limit(NAMED).collect()]
        raise ValueError(f"{what} do not reproduce the stored ones: {dict(sorted(map(tuple, n)))}: {first}")
    return observed


def _certain(ok: Column, message: Column) -> Column:
    """A filter that lets every row through or ends the job."""
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def out_of_fold(validation: DataFrame, test: DataFrame, expected: DataFrame, fold: str, key: str, label: str, score: str, max_fpr: float = 0.10) -> DataFrame:
    """Each expected key once, with its fold, label and score, and for each rule the threshold of its fold, chosen on that fold's validation rows alone, and
    the decision. The plan itself ends with an error if a key of expected is not in test, is there twice, or test has another, and if a fold has no
    threshold. Thresholds are one row a fold; counts fold before their shuffle."""
    points = me.operating_points(validation, [fold], label, score)
    chosen = None
    for name, rule in RULES.items():
        one = me.select_threshold(points, [fold], rule, max_fpr).select(fold, F.col("threshold").alias(f"threshold_{name}"))
        chosen = one if chosen is None else chosen.join(one, fold)
    row = F.struct(*[F.col(c).alias(f"__{c}") for c in (fold, label, score)])
    got = test.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"), F.first(row).alias("__r"))
    want = expected.select(F.col(key)).distinct()
    j = want.join(got, F.col(key).eqNullSafe(F.col("__key")), "full")
    once = F.col(key).isNotNull() & F.coalesce(F.col("__n") == 1, F.lit(False))
    j = j.where(_certain(once, F.concat(F.lit(f"out of fold: {key} "), F.coalesce(F.coalesce(F.col(key), F.col("__key")).cast("string"), F.lit("null")), F.lit(" is not expected or not there once"))))
    j = j.select(key, *[F.col(f"__r.__{c}").alias(c) for c in (fold, label, score)]).join(chosen, fold, "left")
    j = j.where(_certain(F.col(f"threshold_{next(iter(RULES))}").isNotNull(), F.concat(F.lit("out of fold: no threshold of fold "), F.coalesce(F.col(fold).cast("string"), F.lit("null")))))
    return j.select(key, fold, label, score, *[f"threshold_{n}" for n in RULES], *[(F.col(score) >= F.col(f"threshold_{n}")).alias(f"prediction_{n}") for n in RULES])
