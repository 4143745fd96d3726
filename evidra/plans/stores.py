"""Queries of sinks, caches and resumed streams: what was written is read back and held against the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.plans.queries import query
from evidra.sources import caches as ca
from evidra.sources import parts as pt
from evidra.sources import writers as wr
from evidra.sources.readers import table
from evidra.streaming import resume as rs

#: Rows of a part, and buckets of a cache.
PART_ROWS = 256
BUCKETS = 64


@query(f"""WITH n AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // {PART_ROWS} AS p FROM documents)
           SELECT CAST(p AS INTEGER) AS part, count(*) AS n_rows, sum(length(text)) AS chars, count(text) AS texts, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS ids_sha256 FROM n GROUP BY p""")
def json_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as gzip JSON lines in parts of 256 rows by doc_id, read back from the parts after their digests were checked."""
    path = wr.scratch(spark, "json_parts")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    pt.write_parts(d, path, ["doc_id"], PART_ROWS, zipped=True, config={"query": "json_parts"})
    back = pt.read_parts(spark, path, "doc_id long, text string, lang string, source string, n_chars long")
    ids = F.array_join(F.array_sort(F.collect_list("doc_id")), ",")
    return back.groupBy("part").agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("chars"), F.count("text").alias("texts"), F.sha2(ids, 256).alias("ids_sha256"))


@query("""WITH e AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM embeddings)
          SELECT vec_id, sha256('vec:' || vec_id) AS key, CASE WHEN norm > 0 THEN len(embedding) END AS dimension, CASE WHEN norm > 0 THEN len(list_filter(embedding, lambda x: x > 0)) END AS n_positive,
                 CASE WHEN norm > 0 THEN list_position(embedding, list_max(embedding)) END AS largest FROM e""")
def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised embeddings in a keyed cache, looked up for every row: length, positive numbers and place of the largest; null where a vector has no norm."""
    path = wr.scratch(spark, "cached_vectors")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.sha2(F.concat(F.lit("vec:"), F.col("vec_id").cast("string")), 256).alias("key"), "embedding")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    unit = e.withColumn("norm", norm).where("norm > 0").select("key", F.transform("embedding", lambda x: (x / F.col("norm")).cast("float")).alias("v"))
    dimension = unit.agg(F.max(F.size("v")).alias("d")).first().d or 0
    ca.write_cache(unit, path, "key", "v", dimension, wr.signature({"query": "cached_vectors", "dimension": dimension}), BUCKETS)
    got = ca.lookup(e.select("vec_id", "key"), path, "key")
    v = F.col("vector")
    size = F.when(v.isNotNull(), F.size(v).cast("long"))
    return got.select("vec_id", "key", size.alias("dimension"), F.when(v.isNotNull(), F.size(F.filter(v, lambda x: x > 0)).cast("long")).alias("n_positive"), F.array_position(v, F.array_max(v)).alias("largest"))


@query("""SELECT doc_id, n_chars, CAST(CAST((doc_id * 7919 + 13) % 1000 AS DOUBLE) / 1000 AS DOUBLE) AS score, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 256 AS INTEGER) AS part FROM documents""")
def resumed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by a stream that is started twice on one checkpoint, then closed into ordered parts of 256 rows."""
    path = wr.scratch(spark, "resumed_scores")
    d = table(spark, sf_dir, "documents")
    config = {"query": "resumed_scores", "score": "7919,13"}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema if f.name in ("doc_id", "n_chars"))
    # A pattern, since a stream takes a plain path for a folder and the table may be one file.
    for _ in range(2):
        rs.score_available(spark, f"{sf_dir}/documents.parque[t]", schema, lambda x: x.withColumn("score", F.pmod(F.col("doc_id") * 7919 + 13, F.lit(1000)) / 1000.0), f"{path}/scores", f"{path}/checkpoint", "doc_id", "parquet", config)
    rs.finish(spark, d.where("doc_id IS NOT NULL"), f"{path}/scores", f"{path}/final", "doc_id", config, PART_ROWS)
    back = pt.read_parts(spark, f"{path}/final", "doc_id long, n_chars long, score double")
    return back.select("doc_id", "n_chars", "score", "part")
