"""Prompts, stored model decisions and their canonical outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A stored decision of one prompt and model, keyed `prompt_<n>_<model>`.
DECISIONS = "map<string, struct<alucinacao: boolean, explicacao: string, trechos_para_basear_analise: array<string>>>"


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """(prompt_id, system, user_template) of the files in a folder: a system part, a user part that has both placeholders."""
    t = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("prompt_id"), "value")
    head, mark = "[System]\n", "[User]\n"
    at = F.instr("value", mark)
    parts = t.select(
        "prompt_id",
        F.col("value").substr(F.lit(len(head) + 1), at - 1 - len(head)).alias("system"),
        F.when(F.col("value").startswith(head) & (at > 0), F.col("value").substr(at + len(mark), F.length("value"))).otherwise("").alias("user_template"),
    )
    ok = F.col("user_template").contains("{TEXTO}") & F.col("user_template").contains("{OPINIAO}")
    return parts.withColumn("user_template", F.when(ok, F.col("user_template")).otherwise(F.raise_error(F.concat(F.lit("not a prompt template: "), F.col("prompt_id")))))


def messages(examples: DataFrame, prompts: DataFrame, evidence: str = "evidence", opinion: str = "opinion") -> DataFrame:
    """Every example with every prompt: evidence passages joined by blank lines put into the template. Prompts are few, by configuration."""
    text = F.array_join(F.col(evidence), "\n\n")
    filled = F.replace(F.replace(F.col("user_template"), F.lit("{TEXTO}"), text), F.lit("{OPINIAO}"), F.col(opinion))
    return examples.crossJoin(F.broadcast(prompts)).withColumn("user_message", filled).withColumnRenamed("system", "system_message").drop("user_template")


def pair_parts(key: Column) -> tuple[Column, Column]:
    """(model, prompt) of a decision's key."""
    pattern = r"^(prompt_[^_]+)_(.+)$"
    ok = F.when(key.rlike(pattern), key).otherwise(F.raise_error(F.concat(F.lit("not a decision key: "), key)))
    return F.regexp_extract(ok, pattern, 2), F.regexp_extract(ok, pattern, 1)


def stored(verification: Column | str) -> Column:
    """The decisions (DECISIONS) in a verification's JSON text; other keys are left out."""
    v = F.col(verification) if isinstance(verification, str) else verification
    raw = F.map_filter(F.from_json(v, "map<string, string>"), lambda k, x: k.startswith("prompt_"))
    one = DECISIONS.removeprefix("map<string, ").removesuffix(">")
    return F.transform_values(raw, lambda k, x: F.from_json(x, one))


def decisions(examples: DataFrame, column: str = "verification") -> DataFrame:
    """One row for each stored decision of an example: example_id, label, model, prompt, predicted, decision. column: DECISIONS, or JSON text."""
    made = stored(column) if dict(examples.dtypes)[column] == "string" else F.col(column)
    long = examples.select("example_id", "label", F.explode(F.map_filter(made, lambda k, v: k.startswith("prompt_"))).alias("key", "decision"))
    model, prompt = pair_parts(F.col("key"))
    return long.select("example_id", "label", model.alias("model"), prompt.alias("prompt"), F.col("decision.alucinacao").alias("predicted"), "decision")


def canonical_output(decision: Column, prompt: Column) -> Column:
    """Compact JSON of a decision; passages only for the prompts that ask for them. A missing judgment or explanation is an error."""
    d = F.when(decision["alucinacao"].isNotNull() & decision["explicacao"].isNotNull(), decision).otherwise(F.raise_error(F.lit("decision without judgment or explanation")))
    short = F.to_json(F.struct(d["alucinacao"].alias("alucinacao"), d["explicacao"].alias("explicacao")))
    full = F.to_json(F.struct(d["alucinacao"].alias("alucinacao"), d["explicacao"].alias("explicacao"), F.coalesce(d["trechos_para_basear_analise"], F.raise_error(F.lit("decision without passages")).cast("array<string>")).alias("trechos_para_basear_analise")))
    return F.when(prompt.isin("prompt_2", "prompt_3"), full).otherwise(short)


def token_totals(tokens: DataFrame, keys: list[str], count: str) -> DataFrame:
    return tokens.groupBy(*keys).agg(F.sum(count).alias("total"), F.avg(count).alias("mean"), F.percentile(count, F.lit(0.5)).alias("median"), F.count("*").alias("n"))
