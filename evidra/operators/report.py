"""Report tables: pivots, deltas against a reference, audits, and small texts for people. What is formatted is a summary of at most some hundred rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators.bootstrap import verdict


def wide(summary: DataFrame, keys: list[str], names: list[str], column: str = "metric", value: str = "value") -> DataFrame:
    return summary.groupBy(*keys).pivot(column, names).agg(F.first(value))


def deltas(rows: DataFrame, is_reference: Column, metrics: list[str], lower_better: tuple[str, ...] = ("fpr",)) -> DataFrame:
    """Each other row against the one reference row; the sign is turned where lower is better, so that positive favours the reference."""
    ref = rows.where(is_reference).select(*[F.col(m).alias(f"ref_{m}") for m in metrics])
    if ref.count() != 1:
        raise ValueError("there must be one reference row")
    sign = lambda m: F.lit(-1 if m in lower_better else 1)
    return rows.where(~is_reference).crossJoin(F.broadcast(ref)).select(*[c for c in rows.columns if c not in metrics], *[((F.col(f"ref_{m}") - F.col(m)) * sign(m)).alias(m) for m in metrics])


def points(summary: DataFrame) -> DataFrame:
    """(condition, metric, value) of both sides of all contrasts; several values for one are an error."""
    sides = summary.select(F.explode(F.array(F.struct(F.col("condition_a").alias("condition"), F.col("point_a").alias("value")), F.struct(F.col("condition_b").alias("condition"), F.col("point_b").alias("value")))).alias("p"), "metric")
    got = sides.select("p.*", "metric").where("value IS NOT NULL").groupBy("condition", "metric").agg(F.countDistinct("value").alias("n"), F.first("value").alias("value"))
    return got.withColumn("value", F.when(F.col("n") == 1, F.col("value")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("conflicting points for"), "condition", "metric")))).drop("n")


def direction_mismatches(summary: DataFrame) -> DataFrame:
    """Rows whose stated direction is not what interval, metric and family say."""
    expected = verdict(family=F.col("contrast_family"))
    return summary.withColumn("expected", expected).where(~F.col("expected").eqNullSafe(F.col("significant_direction")))


def fixed(x: Column | str, signed: bool = False) -> Column:
    return F.format_string("%+.4f" if signed else "%.4f", F.col(x) if isinstance(x, str) else x)


def interval(low: str = "ci_low", high: str = "ci_high") -> Column:
    return F.concat(F.lit("["), fixed(low), F.lit(", "), fixed(high), F.lit("]"))


def _cells(df: DataFrame, limit: int) -> list[list[str]]:
    """The rows as text. A report of more than limit rows is an error, not a shorter report."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows: aggregate first, or write a table")
    return [["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]


def markdown(df: DataFrame, limit: int = 500) -> str:
    rows = [df.columns, ["---"] * len(df.columns), *_cells(df, limit)]
    return "\n".join("| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in rows) + "\n"


def latex(df: DataFrame, caption: str, limit: int = 500) -> str:
    special = str.maketrans({c: f"\\{c}" for c in "&%$#_{}"})
    rows = [" & ".join(c.translate(special) for c in r) + r" \\" for r in [df.columns, *_cells(df, limit)]]
    return "\n".join([r"\begin{table}", rf"\caption{{{caption.translate(special)}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", rows[0], r"\hline", *rows[1:], r"\hline", r"\end{tabular}", r"\end{table}"]) + "\n"
