"""Labels stay out of scoring: what a plan reads is looked up in the plan itself, and labels are joined afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _leaves(plan) -> list:  # noqa: ANN001
    found = []
    every = [plan.collectLeaves()] + [s.collectLeaves() for s in _each(plan.subqueriesAll())]
    for leaves in every:
        for leaf in _each(leaves):
            found += _leaves(leaf.relation().cachedPlan()) if leaf.getClass().getSimpleName() == "InMemoryTableScanExec" else [leaf]
    return found


def _each(seq) -> list:  # noqa: ANN001
    return [seq.apply(i) for i in range(seq.size())]


def read_columns(df: DataFrame) -> set[str]:
    """Columns, in lower case, that the scans of df's physical plan read once unused ones are pruned; scans inside of subqueries and of cached tables
    count. A column that is renamed, computed with, filtered on or joined by counts under its name in the source. A table that was written and read again
    is a source of its own."""
    plan = df._jdf.queryExecution().sparkPlan()
    return {a.name().lower() for leaf in _leaves(plan) for a in _each(leaf.output())}


def refuse_reads(df: DataFrame, forbidden: list[str], what: str = "scoring") -> DataFrame:
    """df, unless its plan reads a forbidden column of any source, however it is called in df."""
    leaked = sorted(read_columns(df) & {c.lower() for c in forbidden})
    if leaked:
        raise ValueError(f"{what} reads {leaked}")
    return df


def label_after(scores: DataFrame, labels: DataFrame, key: str, label: str, rows: int | None = None, positives: int | None = None) -> DataFrame:
    """scores with their label, joined only now: both sides need the same keys, each once, and labels of 0 or 1; with rows and positives, those counts.
    One full join and one aggregate check it; the plan of scores must not read the label."""
    refuse_reads(scores, [label])
    a = scores.groupBy(key).agg(F.count("*").alias("__a"))
    b = labels.groupBy(key).agg(F.count("*").alias("__b"), F.sum(F.col(label).cast("int")).alias("__y"), F.count_if(F.coalesce(~F.col(label).cast("double").isin(0.0, 1.0), F.lit(True))).alias("__bad"))
    r = a.join(b, key, "full").agg(
        F.count_if(F.expr("__b IS NULL")).alias("without a label"),
        F.count_if(F.expr("__a IS NULL")).alias("without a score"),
        F.count_if(F.expr("__a > 1 OR __b > 1")).alias("repeated"),
        F.coalesce(F.sum("__bad"), F.lit(0)).alias("labels not 0 or 1"),
        F.count("*").alias("rows"),
        F.coalesce(F.sum("__y"), F.lit(0)).alias("positives"),
    ).first().asDict()
    got = {"rows": r.pop("rows"), "positives": r.pop("positives")}
    wrong = {k: v for k, v in r.items() if v} | {k: (got[k], v) for k, v in {"rows": rows, "positives": positives}.items() if v is not None and got[k] != v}
    if wrong:
        raise ValueError(f"labels: {wrong}")
    return scores.join(labels.select(key, label), key)
