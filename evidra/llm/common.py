"""What the corpus operators share: scratch tables, code shipping, batch slicing, the held-out rule."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python; operators slice further by bytes.
ARROW_ROWS = 256
#: Label values that a classifier learns at most.
MOST_LABELS = 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers of any executor, once per application; and bound the rows of an Arrow batch for the
    session (spark.sql.execution.arrow.maxRecordsPerBatch), so that very long texts don't meet in one by the thousands."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if getattr(sc, "_evidra_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="evidra-")) / "evidra_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._evidra_shipped = True


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; a
    cluster's executors could not read that, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_evidra_scratch", None)
        if not base:
            base = spark.sparkContext._evidra_scratch = tempfile.mkdtemp(prefix="evidra-scratch-")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{scratch(spark)}/evidra/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def materialise(df: DataFrame, tag: str, **options: str | int) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors. options are the writer's."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    schema = df.schema
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Remove a materialised table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) of consecutive rows with at most max_bytes together; a longer
    text comes alone. Null texts have no bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if not n:
        return
    _, off_buf, data_buf = col.buffers()
    off = np.frombuffer(off_buf, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + max_bytes, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def filter_rows(docs: DataFrame, text_col: str, flags: dict[str, Column], judge: Callable[[pa.RecordBatch, str], np.ndarray]) -> DataFrame:
    """The rows of docs, all columns, that judge(batch, name of the text column) marks. Rows pass through Python as they are: no id, no
    shuffle. flags are further columns for the judge alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(judge(batch, text), pa.bool_()))

    names = docs.columns
    text = f"c{names.index(text_col)}"
    rows = docs.select(*[v.alias(k) for k, v in flags.items()], *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    return rows.mapInArrow(run, rows.schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def labelled_sample(docs: DataFrame, label: str, per_value: int, id_col: str = "doc_id", most_labels: int = MOST_LABELS) -> DataFrame:
    """Ids (and label) of about per_value rows of each label value, chosen by a hash of the id. Label counts come from
    every row; the choice needs one narrow scan and no sort. Of more than most_labels values the most frequent are learned, ties by
    value: that bounds what a model is trained on."""
    counts = docs.groupBy(label).agg(F.count("*").alias("__n"))
    scale = 1 << 30
    return (
        docs.join(F.broadcast(counts.where(F.col(label).isNotNull()).orderBy(F.desc("__n"), label).limit(most_labels)), label)
        .where(F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(scale)).cast("double") * F.col("__n") < float(per_value * scale))
        .drop("__n")
    )
