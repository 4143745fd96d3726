"""JSON lines in parts of exact size: a table in a given order as part-000000.jsonl[.gz] and so on, equal bytes at every run.

Rows are numbered by the offsets of sorted partitions, a task takes whole blocks of parts and holds one part at a time. A part appears whole
(written beside its name, then moved), so a run that died goes on with the parts it lacks. Digests stand in one small file a block, counts in the manifest."""

from __future__ import annotations

import gzip
import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from evidra.sources.writers import settled, signature

#: Parts whose digests share a file; a block is written by one task.
BLOCK = 64
DIGEST = "part int, rows long, sha256 string, file_sha256 string"


def open_store(path: str):  # noqa: ANN201
    """(file system, root) of a URI or an absolute path, for code in Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/") if path.startswith("file:") else path)


def present(store, path: str) -> bool:  # noqa: ANN001
    from pyarrow import fs

    return store.get_file_info(path).type != fs.FileType.NotFound


def read_bytes(store, path: str) -> bytes:  # noqa: ANN001
    with store.open_input_file(path) as f:
        return f.read()


def put(store, path: str, data: bytes) -> None:  # noqa: ANN001
    """The file appears whole: an attempt that dies leaves a name that starts with a dot."""
    folder, name = posixpath.split(path)
    beside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(beside, compression=None) as f:
        f.write(data)
    store.move(beside, path)


@dataclass
class Counts(WriterCommitMessage):
    rows: int
    parts: int
    kept: int


class PartsWriter(DataSourceArrowWriter):
    """Rows (part, line) in the order of their number; a part lies in one task."""

    def __init__(self, options: dict) -> None:
        self.path, self.zipped, self.sign = options["path"], options["gzip"] == "true", options["signature"]

    def name(self, part: int) -> str:
        return f"part-{part:06d}.jsonl" + (".gz" if self.zipped else "")

    def write(self, iterator: Iterator) -> Counts:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        got, kept, block, digests = Counts(0, 0, 0), 0, None, []
        for part, lines in self.grouped(iterator):
            if block is not None and part // BLOCK != block:
                self.close_block(store, root, block, digests)
                digests = []
            block = part // BLOCK
            digest, old = self.put_part(store, root, part, lines)
            digests.append(digest)
            kept += old
            got = Counts(got.rows + len(lines), got.parts + 1, kept)
        if digests:
            self.close_block(store, root, block, digests)
        return got

    @staticmethod
    def grouped(iterator: Iterator) -> Iterator[tuple[int, list[str]]]:
        part, lines = None, []
        for batch in iterator:
            for p, line in zip(batch.column("part").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if part is not None and p != part:
                    yield part, lines
                    lines = []
                part = p
                lines.append(line)
        if lines:
            yield part, lines

    def put_part(self, store, root: str, part: int, lines: list[str]) -> tuple[dict, bool]:  # noqa: ANN001
        data = "".join(f"{x}\n" for x in lines).encode()
        path = f"{root}/{self.name(part)}"
        old = present(store, path)
        if old:
            raw = read_bytes(store, path)
            if (gzip.decompress(raw) if self.zipped else raw) != data:
                raise ValueError(f"{path} holds other rows than this run: parts of different runs do not mix")
        else:
            raw = gzip.compress(data, 9, mtime=0) if self.zipped else data
            put(store, path, raw)
        return {"part": part, "rows": len(lines), "sha256": hashlib.sha256(data).hexdigest(), "file_sha256": hashlib.sha256(raw).hexdigest()}, old

    @staticmethod
    def close_block(store, root: str, block: int, digests: list[dict]) -> None:  # noqa: ANN001
        put(store, f"{root}/digests-{block:06d}.json", "".join(json.dumps(d, sort_keys=True) + "\n" for d in digests).encode())

    def commit(self, messages: list) -> None:
        store, root = open_store(self.path)
        done = [m for m in messages if m is not None]
        manifest = {"status": "complete", "signature": self.sign, "rows": sum(m.rows for m in done), "parts": sum(m.parts for m in done)}
        store.create_dir(root, recursive=True)
        put(store, f"{root}/_manifest.json", json.dumps(manifest, sort_keys=True).encode())

    def abort(self, messages: list) -> None:
        """Whole parts stay for the next run; there is no manifest, so nobody takes them for a result."""


class Parts(DataSource):
    """Format evidra_parts; options path, gzip, signature."""

    @classmethod
    def name(cls) -> str:
        return "evidra_parts"

    def writer(self, schema, overwrite: bool) -> PartsWriter:  # noqa: ANN001
        return PartsWriter(self.options)


def numbered(df: DataFrame, order: list[str], number: str = "number") -> DataFrame:
    """df with a row number from 0 in the given order: a distributed sort, positions inside a partition, and the partitions' offsets (one row a
    partition). The order must be total, or equal rows may trade places."""
    s = df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id())
    s = settled(s.select("*", F.shiftright("__m", 33).alias("__p"), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)).alias("__i")).drop("__m"), "numbered")
    sizes = s.groupBy("__p").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__o"))
    return s.join(F.broadcast(offsets), "__p").select(*df.columns, (F.col("__o") + F.col("__i")).alias(number))


def json_line(df: DataFrame) -> Column:
    """A row as JSON, nulls kept."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def write_parts(df: DataFrame, path: str, order: list[str], rows: int = 256, zipped: bool = False, config: dict | None = None) -> dict:
    """df's rows in a total order as parts of `rows` rows (the last may be shorter) and the manifest. A complete folder of the same config is left
    as it is, one of another config is refused, one without manifest is completed. An empty table gives a manifest alone."""
    spark = df.sparkSession
    sign = signature({"config": config or {}, "rows": rows, "gzip": zipped, "order": order, "columns": df.dtypes})
    store, root = open_store(path)
    if present(store, f"{root}/_run.json"):
        if json.loads(read_bytes(store, f"{root}/_run.json"))["signature"] != sign:
            raise ValueError(f"{path}: parts of another signature")
        if present(store, f"{root}/_manifest.json"):
            return json.loads(read_bytes(store, f"{root}/_manifest.json"))
    else:
        store.create_dir(root, recursive=True)
        put(store, f"{root}/_run.json", json.dumps({"signature": sign}).encode())
    n = numbered(df.select(json_line(df).alias("line"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(order)]), [f"__k{i}" for i in range(len(order))])
    n = n.select(F.floor(F.col("number") / rows).cast("int").alias("part"), "number", "line")
    block = F.floor(F.col("part") / BLOCK)
    spark.dataSource.register(Parts)
    out = n.repartition(block).sortWithinPartitions("part", "number").select("part", "line")
    out.write.format("evidra_parts").mode("append").option("gzip", str(zipped).lower()).option("signature", sign).save(path)
    return json.loads(read_bytes(store, f"{root}/_manifest.json"))


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a complete folder, with their part, after every part's bytes were held against its digest."""
    store, root = open_store(path)
    if not present(store, f"{root}/_manifest.json"):
        raise ValueError(f"{path}: no manifest, the run is not complete")
    manifest = json.loads(read_bytes(store, f"{root}/_manifest.json"))
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)\.", 1).cast("int")
    if not manifest["parts"]:
        return spark.createDataFrame([], schema).withColumn("part", F.lit(0))
    have = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(number.alias("part"), F.sha2("content", 256).alias("got"))
    want = spark.read.schema(DIGEST).option("pathGlobFilter", "digests-*").json(path)
    off = have.join(want, "part", "full").agg(F.count_if(~F.col("got").eqNullSafe(F.col("file_sha256"))).alias("bad"), F.sum("rows").alias("rows")).first()
    if off.bad or off.rows != manifest["rows"]:
        raise ValueError(f"{path}: {off.bad} parts changed or lost, {off.rows} of {manifest['rows']} rows")
    return spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", "part-*").json(path).select("*", number.alias("part"))
