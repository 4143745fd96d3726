"""Writers: staged directories that appear whole or not at all, manifests with hashes of content, resumable appends."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def signature(payload: object) -> str:
    """First 16 hex digits of the sha256 of canonical JSON."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:16]


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def content_hash(df: DataFrame) -> str:
    """A hash of a table's rows whatever their order and files: counts, sums of two 32-bit halves of row hashes."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    r = df.agg(F.count("*"), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first()
    return signature([int(x or 0) for x in r])


@contextmanager
def staged(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder beside path that becomes path when the block ends, and goes if it fails; refuses an existing path."""
    if exists(spark, path):
        raise FileExistsError(path)
    stage = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    p, fs = _fs(spark, stage)
    try:
        yield stage
        if not fs.rename(p, _fs(spark, path)[0]):
            raise OSError(f"cannot rename to {path}")
    finally:
        fs.delete(p, True)


def write_staged(df: DataFrame, path: str, kind: str = "parquet", **options: str) -> str:
    """Write beside path, then rename; refuses an existing path and leaves nothing if the write fails."""
    with staged(df.sparkSession, path) as stage:
        df.write.format(kind).options(**options).save(stage)
    return path


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir. Where the setting is unset, a local master gets a folder of its own; on a cluster that is an error.
    What is written there goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.sparkContext._evidra_settled = getattr(spark.sparkContext, "_evidra_settled", None) or tempfile.mkdtemp(prefix="evidra-settled-")
    path = f"{base.rstrip('/')}/evidra/{tag}-{uuid.uuid4().hex}"
    p, fs = _fs(spark, path)
    fs.deleteOnExit(p)
    return path


def settled(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table in a new folder of scratch, read again: what several plans use is computed once and survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, such as a manifest or report, through the table's own file system."""
    p, fs = _fs(spark, path)
    stage, _ = _fs(spark, f"{path}.tmp-{uuid.uuid4().hex}")
    out = fs.create(stage, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(stage, p):
        raise OSError(f"cannot rename to {path}")


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_run(tables: dict[str, DataFrame], root: str, config: dict) -> str:
    """Tables and a manifest under root/<signature of config>; a complete run is left as it is."""
    spark = next(iter(tables.values())).sparkSession
    run = f"{root.rstrip('/')}/{signature(config)}"
    if exists(spark, f"{run}/manifest.json"):
        return run
    p, fs = _fs(spark, run)
    fs.delete(p, True)
    hashes = {}
    for name, df in tables.items():
        write_staged(df, f"{run}/{name}")
        hashes[name] = content_hash(spark.read.parquet(f"{run}/{name}"))
    write_text(spark, f"{run}/manifest.json", json.dumps({"config": config, "signature": signature(config), "status": "complete", "tables": hashes}, sort_keys=True))
    return run


def read_run(spark: SparkSession, run: str, expected: str | None = None) -> dict[str, DataFrame]:
    """The tables of a complete run, after a check of signature and content."""
    m = json.loads(read_text(spark, f"{run}/manifest.json"))
    if m["status"] != "complete" or m["signature"] != signature(m["config"]) or (expected and m["signature"] != expected):
        raise ValueError(f"{run}: manifest does not fit")
    out = {k: spark.read.parquet(f"{run}/{k}") for k in m["tables"]}
    wrong = [k for k, df in out.items() if content_hash(df) != m["tables"][k]]
    if wrong:
        raise ValueError(f"{run}: content of {wrong} changed")
    return out


def jsonl_by(df: DataFrame, path: str, split: str, gzip: bool = False, max_rows: int = 0) -> None:
    """JSON lines, a folder for each split; with max_rows, files of at most so many."""
    w = df.write.partitionBy(split)
    w = w.option("compression", "gzip") if gzip else w
    (w.option("maxRecordsPerFile", max_rows) if max_rows else w).json(path)


def csv_with_json(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs as JSON text."""
    nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))}
    df.withColumns(nested).write.option("header", True).option("escape", '"').csv(path)


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not in the table at path; the number appended. A job that died can run again."""
    spark = df.sparkSession
    new = df.dropDuplicates([key])
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the largest version of each key: an upsert over an append-only table."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")
