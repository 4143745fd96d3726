"""A corpus pipeline of five stages; each is one operator of evidra.llm over all that the stage before kept.

    language      documents that are in none of the learned languages go: no letter, or a mean probability below language.LEAST
    exact_dedup   of equal texts (white space folded) the smallest doc_id stays
    near_dedup    of linked near duplicates the smallest doc_id stays
    decontaminate documents that hold a benchmark window go
    encode        SentencePiece ids of what is left

All stages but the last return the columns of documents. An empty table passes through; null texts leave at the first stage, also where
there is no labelled row to learn a language from. Ids may repeat; of rows with equal texts one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidra.llm import decontam, exact_dedup, language, near_dedup, pieces
from evidra.llm.common import scratch_path


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language the network knows; it learns from all of docs that are not held out."""
    return language.drop_unknown(docs, language.fit(docs))


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the smallest doc_id."""
    return exact_dedup.drop_exact(docs)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked near duplicates."""
    return near_dedup.drop_near(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any window of the benchmark of sf_dir."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, n_bytes, round_trip, ids (little-endian 16-bit)."""
    import public_tokenizers

    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("row_id", "doc_id")
    return out.select("doc_id", "n_tokens", "ids_crc32", "n_bytes", "round_trip", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", stage_language),
    ("exact_dedup", stage_exact),
    ("near_dedup", stage_near),
    ("decontaminate", stage_decontaminate),
    ("encode", stage_encode),
]

#: Language ID and near duplicates have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
