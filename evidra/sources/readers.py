"""Readers with contracts, and flattening of nested records. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.functions.scalars import reasons
from evidra.functions.text import blank

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: A hearing: nested people, and their opinions. Verifications stay JSON text: beside the manual judgment they hold stored decisions under keys
#: that name prompt and model.
HEARING = (
    "id LONG, metadados_extraidos STRUCT<assunto: STRING, envolvidos: ARRAY<STRUCT<nome: STRING, cargo: STRING, opinioes: ARRAY<STRUCT<"
    "opiniao: STRING, chunks_proximos: ARRAY<STRING>, verificacao_alucinacao: STRING>>>>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame, name: str) -> DataFrame:
    """df of Parquet files with each row's position in them: files by name, rows as they lie in a file."""
    files = df.select(F.col("_metadata.file_path").alias("__file")).distinct()
    files = files.withColumn("__at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__file")).cast("long"))
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return rows.join(F.broadcast(files), "__file").withColumn(name, F.shiftleft("__at", 40) + F.col("__row")).drop("__file", "__at", "__row")


def jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines, plain or gzip; a line that does not parse or is no object is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv(spark: SparkSession, path: str, schema: T.StructType | str, json_columns: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header; columns that hold JSON become what their type says."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.withColumns({c: F.from_json(c, t) for c, t in (json_columns or {}).items()})


def require_columns(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}")
    return df


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """df, after a check that no key is null or occurs twice."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null).limit(5).collect()
    if bad:
        raise ValueError(f"{what}: keys repeat or are null: {[r.asDict() for r in bad]}")
    return df


def predictions(df: DataFrame, score: str, rows: int | None = None, positives: int | None = None, groups: int | None = None) -> DataFrame:
    """df, after one aggregate that checks unique ids, finite scores in [0, 1] and the expected population."""
    r = df.agg(
        F.count("*").alias("rows"),
        F.countDistinct("example_id").alias("ids"),
        F.sum("label").alias("positives"),
        F.countDistinct("hearing_id").alias("groups"),
        F.count_if(F.col(score).isNull() | F.isnan(score) | (F.col(score) < 0) | (F.col(score) > 1)).alias("bad"),
    ).first()
    want = {"rows": rows, "positives": positives, "groups": groups}
    wrong = {k: (r[k], v) for k, v in want.items() if v is not None and r[k] != v}
    if r["bad"] or r["ids"] != r["rows"] or wrong:
        raise ValueError(f"predictions: {r['bad']} bad scores, {r['rows'] - r['ids']} repeated ids, counts {wrong}")
    return df


def conditions(parts: dict[tuple[str, int], DataFrame], score: str = "score") -> DataFrame:
    """One long table (condition, seed, example_id, hearing_id, label, score) of many predictions."""
    out = None
    for (name, seed), df in parts.items():
        one = df.select(F.lit(name).alias("condition"), F.lit(seed).alias("seed"), "example_id", "hearing_id", "label", F.col(score).alias("score"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no conditions")
    return out


def paired(cube: DataFrame) -> DataFrame:
    """cube, after a check that every example has each (condition, seed) once, with one label and one group."""
    n = cube.select("condition", "seed").distinct().count()
    bad = cube.groupBy("example_id").agg(F.count("*").alias("n"), F.countDistinct("label").alias("l"), F.countDistinct("hearing_id").alias("h")).where(f"n <> {n} OR l <> 1 OR h <> 1").count()
    if bad:
        raise ValueError(f"{bad} examples do not pair over {n} runs")
    return cube


def opinions(hearings: DataFrame) -> DataFrame:
    """One row an opinion with its place, person, chunks and label, whether it can be modelled or not."""
    p = hearings.select("id", F.col("metadados_extraidos.assunto").alias("subject"), F.posexplode("metadados_extraidos.envolvidos").alias("person_index", "p"))
    o = p.select("id", "subject", "person_index", F.col("p.nome").alias("person_name"), F.col("p.cargo").alias("person_role"), F.posexplode("p.opinioes").alias("opinion_index", "o"))
    return o.select(
        F.concat_ws(":", F.col("id").cast("string"), "person_index", "opinion_index").alias("sample_id"),
        F.col("id").cast("string").alias("hearing_id"),
        "subject",
        "person_name",
        "person_role",
        F.col("o.opiniao").alias("opinion"),
        F.coalesce("o.chunks_proximos", F.array().cast("array<string>")).alias("context_chunks"),
        F.get_json_object("o.verificacao_alucinacao", "$.verificacao_manual").cast("boolean").alias("label"),
        F.col("o.verificacao_alucinacao").alias("verification"),
    )


def rejection(size: int = 4) -> Column:
    """Why an opinion cannot be modelled, joined; empty if it can."""
    c = F.col("context_chunks")
    return reasons(
        "|",
        missing_hearing=F.col("hearing_id").isNull(),
        blank_opinion=blank("opinion"),
        missing_label=F.col("label").isNull(),
        wrong_chunk_count=F.size(c) != size,
        blank_chunk=F.exists(c, blank),
    )


def normalised(hearings: DataFrame, size: int = 4) -> tuple[DataFrame, DataFrame]:
    """(modelable opinions with an int label, rejected ones with rejection_reason): one plan, two filters."""
    o = opinions(hearings).withColumn("rejection_reason", rejection(size))
    ok = o.where(F.col("rejection_reason") == "").drop("rejection_reason").withColumn("label", F.col("label").cast("int")).withColumn("chunk_count", F.size("context_chunks"))
    return ok, o.where(F.col("rejection_reason") != "").drop("label")
