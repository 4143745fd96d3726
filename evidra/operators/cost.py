"""Token cost in exact decimals: narrow operands keep every digit of the product, results have 18 decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def costs(tokens: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Totals and costs for each key and model: tokens (keys, model, input_tokens, output_tokens), prices (model,
    input_price, output_price) in units of a million tokens. Prices are few, one a model."""
    t = tokens.groupBy(*keys, "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    j = t.join(prices, "model")
    part = lambda n, p: (F.col(n).cast("decimal(12,0)") * F.col(p).cast("decimal(18,13)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(38,18)")
    j = j.withColumn("input_cost", part("input_tokens", "input_price")).withColumn("output_cost", part("output_tokens", "output_price"))
    return j.withColumn("total_cost", (F.col("input_cost") + F.col("output_cost")).cast("decimal(38,18)"))


def campaign(cost: DataFrame, reference: str) -> DataFrame:
    """Total of each model and its ratio to the reference model."""
    total = cost.groupBy("model").agg(F.sum("total_cost").cast("decimal(38,18)").alias("campaign_cost"))
    ref = total.where(F.col("model") == reference).select(F.col("campaign_cost").cast("double").alias("ref"))
    return total.join(F.broadcast(ref)).withColumn("ratio", F.try_divide(F.col("campaign_cost").cast("double"), F.col("ref"))).drop("ref")
