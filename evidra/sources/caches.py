"""Vector caches keyed by content hash: bucketed files with a manifest, read as a data source that takes keys and checks what it reads.

A cache is written once for a signature (model, dimension, input). Keys fall into buckets by their crc32, a file a bucket; a reader opens the
buckets of the keys asked for and no others. A vector that is not finite, has another length than the manifest says or a norm off 1 is an error,
never a row."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from evidra.sources.parts import open_store, present, put, read_bytes

SCHEMA = "key string, vector array<float>"
#: How far a norm may be off 1.
NORM = 2e-3
#: Vectors of a batch that a reader hands over.
BATCH = 4096


def bucket_of(key: str, buckets: int) -> int:
    return zlib.crc32(key.encode()) % buckets


def bucket(key: Column | str, buckets: int) -> Column:
    """The same in the JVM."""
    return F.pmod(F.crc32(F.col(key) if isinstance(key, str) else key), F.lit(buckets)).cast("int")


def faults(vectors: np.ndarray) -> np.ndarray:
    """Which rows are not finite or not of norm 1."""
    with np.errstate(all="ignore"):
        return ~(np.isfinite(vectors).all(axis=1) & (np.abs(np.linalg.norm(vectors.astype(np.float64), axis=1) - 1.0) <= NORM))


def matrix(column, dimension: int, where: str) -> np.ndarray:  # noqa: ANN001
    """A list column as rows of one length; nulls and other lengths are errors."""
    flat = column.flatten()
    if column.null_count or flat.null_count or (np.diff(np.asarray(column.offsets)) != dimension).any():
        raise ValueError(f"{where}: a vector is missing or has not {dimension} numbers")
    return flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimension)


@dataclass
class Written(WriterCommitMessage):
    rows: int


class CacheWriter(DataSourceArrowWriter):
    """Rows (bucket, key, vector) sorted by bucket and key; a bucket lies in one task, so a repeated key is seen."""

    def __init__(self, options: dict) -> None:
        self.path, self.dimension = options["path"], int(options["dimension"])

    def write(self, iterator: Iterator) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq

        store, root = open_store(self.path)
        rows, now, sink, out, last = 0, None, None, None, None

        def finish() -> None:
            out.close()
            put(store, f"{root}/bucket-{now:05d}.parquet", sink.getvalue().to_pybytes())

        for batch in iterator:
            vectors = matrix(batch.column("vector"), self.dimension, self.path)
            bad = faults(vectors)
            if bad.any():
                raise ValueError(f"{self.path}: the vector of {batch.column('key')[int(bad.argmax())]} is not finite or not of norm 1")
            numbers, keys = np.asarray(batch.column("bucket")), batch.column("key")
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
            for a, b in zip(map(int, edges), map(int, edges[1:]), strict=False):
                if a == b:
                    continue
                if numbers[a] != now:
                    if now is not None:
                        finish()
                    now, sink, last = int(numbers[a]), pa.BufferOutputStream(), None
                    out = pq.ParquetWriter(sink, pa.schema([("key", pa.string()), ("vector", pa.list_(pa.float32(), self.dimension))]), compression="zstd")
                names = keys.slice(a, b - a).to_pylist()
                if None in names or last == names[0] or any(x == y for x, y in zip(names, names[1:], strict=False)):
                    raise ValueError(f"{self.path}: a key is null or repeats")
                last = names[-1]
                out.write_table(pa.table({"key": pa.array(names), "vector": pa.FixedSizeListArray.from_arrays(pa.array(vectors[a:b].ravel()), self.dimension)}, schema=out.schema))
                rows += b - a
        if now is not None:
            finish()
        return Written(rows)

    def commit(self, messages: list) -> None:
        store, root = open_store(self.path)
        meta = json.loads(read_bytes(store, f"{root}/_run.json")) | {"rows": sum(m.rows for m in messages if m is not None), "status": "complete"}
        put(store, f"{root}/_manifest.json", json.dumps(meta, sort_keys=True).encode())

    def abort(self, messages: list) -> None:
        """Without a manifest no reader takes the folder for a cache."""


@dataclass
class Bucket(InputPartition):
    number: int

    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


class CacheReader(DataSourceReader):
    """One partition a bucket. Asked for keys, it opens their buckets only and gives their rows only."""

    def __init__(self, options: dict) -> None:
        self.path, self.keys, self.buckets = options["path"], None, None
        if "keys" in options:
            self.keys = set(json.loads(options["keys"]))
        if "buckets" in options:
            self.buckets = set(json.loads(options["buckets"]))
        store, root = open_store(self.path)
        if not present(store, f"{root}/_manifest.json"):
            raise ValueError(f"{self.path}: no complete cache")
        self.meta = json.loads(read_bytes(store, f"{root}/_manifest.json"))
        if options.get("signature", self.meta["signature"]) != self.meta["signature"]:
            raise ValueError(f"{self.path}: the cache has signature {self.meta['signature']}, not {options['signature']}")

    def partitions(self) -> list[Bucket]:
        n = self.meta["buckets"]
        asked = set(range(n)) if self.keys is None else {bucket_of(k, n) for k in self.keys}
        return [Bucket(b) for b in sorted(asked if self.buckets is None else asked & self.buckets)]

    def read(self, partition: Bucket) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        store, root = open_store(self.path)
        path = f"{root}/bucket-{partition.number:05d}.parquet"
        if not present(store, path):  # a bucket that no key falls into has no file
            return
        with store.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(BATCH):
                if self.keys is not None:
                    batch = batch.filter(pa.compute.is_in(batch.column("key"), value_set=pa.array(sorted(self.keys), pa.string())))
                if not batch.num_rows:
                    continue
                column = batch.column("vector")
                if column.type.list_size != self.meta["dimension"] or column.null_count:
                    raise ValueError(f"{path}: vectors of {column.type.list_size} numbers, the manifest says {self.meta['dimension']}")
                vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.meta["dimension"])
                bad = faults(vectors)
                if bad.any():
                    raise ValueError(f"{path}: the vector of {batch.column('key')[int(bad.argmax())]} is not finite or not of norm 1")
                offsets = pa.array(np.arange(0, vectors.size + 1, self.meta["dimension"], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], names=["key", "vector"])


class VectorCache(DataSource):
    """Format evidra_vectors; options path, signature to be held against the cache's own, keys and buckets as JSON lists."""

    @classmethod
    def name(cls) -> str:
        return "evidra_vectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CacheReader:  # noqa: ANN001
        return CacheReader(self.options)

    def writer(self, schema, overwrite: bool) -> CacheWriter:  # noqa: ANN001
        return CacheWriter(self.options)


def write_cache(df: DataFrame, path: str, key: str, vector: str, dimension: int, signature: str, buckets: int = 64) -> str:
    """df's vectors of norm 1 under their keys. A complete cache of this signature is left alone; one of another is refused. Null or repeated keys
    and bad vectors are errors and leave no manifest. Choose buckets so that a bucket's vectors fit in a task's memory."""
    spark = df.sparkSession
    store, root = open_store(path)
    meta = {"signature": signature, "dimension": dimension, "buckets": buckets}
    if present(store, f"{root}/_run.json"):
        if json.loads(read_bytes(store, f"{root}/_run.json")) != meta:
            raise ValueError(f"{path}: a cache of another signature or shape")
        if present(store, f"{root}/_manifest.json"):
            return path
    else:
        store.create_dir(root, recursive=True)
        put(store, f"{root}/_run.json", json.dumps(meta, sort_keys=True).encode())
    spark.dataSource.register(VectorCache)
    # A null key must reach the writer to be refused; it goes to bucket 0.
    b = F.coalesce(bucket(F.col(key).cast("string"), buckets), F.lit(0)).alias("bucket")
    rows = df.select(b, F.col(key).cast("string").alias("key"), F.col(vector).cast("array<float>").alias("vector"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "key").write.format("evidra_vectors").mode("append").option("dimension", dimension).save(path)
    return path


def read_cache(spark: SparkSession, path: str, signature: str | None = None, keys: list[str] | None = None, buckets: list[int] | None = None) -> DataFrame:
    """(key, vector) of a complete cache; with keys (a short list), of these alone, from their buckets alone.

    The keys are an option and not a pushed filter: Spark 4.1 keeps what a Python source was pushed with the loaded relation, so that a filter of
    one plan would also cut the rows of the next plan over the same table."""
    spark.dataSource.register(VectorCache)
    r = spark.read.format("evidra_vectors")
    for name, value in (("signature", signature), ("keys", None if keys is None else json.dumps(keys)), ("buckets", None if buckets is None else json.dumps(buckets))):
        r = r if value is None else r.option(name, value)
    return r.load(path)


def lookup(asked: DataFrame, path: str, key: str, signature: str | None = None) -> DataFrame:
    """asked with the vector of each row's key, null where the cache lacks it. Only buckets that some key falls into are opened; their numbers, at most
    as many as the cache has buckets, are what the driver sees."""
    spark = asked.sparkSession
    store, root = open_store(path)
    if not present(store, f"{root}/_manifest.json"):
        raise ValueError(f"{path}: no complete cache")
    n = json.loads(read_bytes(store, f"{root}/_manifest.json"))["buckets"]
    used = [r[0] for r in asked.where(F.col(key).isNotNull()).select(bucket(F.col(key), n)).distinct().collect()]
    return asked.join(read_cache(spark, path, signature, buckets=used).withColumnRenamed("key", key), key, "left")


def content_key(*parts: str) -> str:
    """The key of a text under a model: sha256 over parts that a zero byte sets apart."""
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()
