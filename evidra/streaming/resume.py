"""Resumable scoring as a stream that ends: each key is scored once, whatever dies in between, and only under one fingerprint."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.sources.parts import write_parts
from evidra.sources.writers import exists, read_text, signature, write_text

FINGERPRINT = "execution_fingerprint"
#: Keys on disk, not in the executors' heap, and stores closed at commit, so that no start leaves open ones behind. A checkpoint keeps the store of its first start.
STORES = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.unloadOnCommit": "true"}


def bind(spark: SparkSession, checkpoint: str, config: dict) -> str:
    """The fingerprint of config, which the checkpoint keeps from its first start on; another one is refused."""
    mine, path = signature(config), f"{checkpoint.rstrip('/')}/fingerprint.json"
    if exists(spark, path):
        old = json.loads(read_text(spark, path))["fingerprint"]
        if old != mine:
            raise ValueError(f"{checkpoint} belongs to fingerprint {old}, not {mine}: its scores cannot be used again")
    else:
        write_text(spark, path, json.dumps({"fingerprint": mine}))
    return mine


def score_available(spark: SparkSession, source: str, schema: str, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str, kind: str = "json", config: dict | None = None) -> None:
    """Score the new files in source into the Parquet table sink; every row carries the fingerprint.

    Keys seen are keyed state of the stream, cut by key over the shuffle partitions, so a batch costs its own rows and the sink is never read again.
    The file sink's log takes a batch once: a restart in mid batch repeats the batch and drops what the dead one left. Rows with a null key are
    left out. score must work row by row. Of rows with one key in one batch any may be taken: give equal ones."""
    mark = bind(spark, checkpoint, config or {})
    stream = spark.readStream.format(kind).schema(schema).load(source)
    new = score(stream.where(F.col(key).isNotNull()).dropDuplicates([key])).withColumn(FINGERPRINT, F.lit(mark))
    before = {k: spark.conf.get(k, None) for k in STORES}
    for k, v in STORES.items():
        spark.conf.set(k, v)
    try:
        query = new.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def finish(spark: SparkSession, expected: DataFrame, sink: str, path: str, key: str, config: dict | None = None, rows: int = 256) -> dict:
    """The ordered final file: the scores of all expected keys, in the order of key, as parts of exact size. Missing, unexpected or repeated keys
    and rows of another fingerprint are errors, and the scores stay for another start. Gives the manifest."""
    mark = signature(config or {})
    got = spark.read.parquet(sink)
    n = got.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(FINGERPRINT) != mark).alias("other"))
    j = expected.select(F.col(key)).distinct().withColumn("want", F.lit(True)).join(n, key, "full")
    off = j.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("unexpected"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("other") > 0).alias("foreign")).first()
    if any(off):
        raise ValueError(f"{sink}: {off.asDict()}")
    return write_parts(got, path, [key], rows, config=config)
