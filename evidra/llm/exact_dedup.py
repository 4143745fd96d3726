"""Exact deduplication with Patricia tries as owners of equal texts.

Texts are equal when their normalised UTF-8 bytes are. A (length, hash) pair of the bytes names a partition, which owns
one compressed radix trie over full byte strings; a terminal node holds the smallest id and the number of rows. Tries
are built twice: first inside each input task, where rows with equal texts fold into one terminal before anything is
shuffled, so that a text copied to a third of all rows reaches its owner once per task window; then over those
terminals, dealt by (length, hash) and sorted, one trie at a time. A task's tries are flushed ("spilled") partition by
partition once they hold SPILL_BYTES of text; flushing only leaves more terminals to the second step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import materialise, ship, text_slices

#: Bytes of text that a task's tries hold before they are flushed, and rows.
SPILL_BYTES, SPILL_ROWS = 48 << 20, 200_000
SPACES = r"[\x20\x09-\x0D]+"


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving: comparisons stay in C."""
    if a == b:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Node:
    """An edge's bytes with what hangs below them; owner is not None where a stored string ends."""

    __slots__ = ("count", "edge", "kids", "low", "owner")

    def __init__(self, edge: bytes) -> None:
        self.edge, self.kids, self.owner, self.low, self.count = edge, None, None, None, 0


class Patricia:
    """A compressed radix trie over byte strings."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def terminal(self, key: bytes) -> Node:
        """The node where key ends, made if new."""
        node, at = self.root, 0
        while at < len(key):
            kids = node.kids = node.kids or {}
            kid = kids.get(key[at])
            if kid is None:
                kid = kids[key[at]] = Node(key[at:] if at else key)
                return kid
            rest = key[at:] if at else key
            n = common_prefix(kid.edge, rest)
            if n < len(kid.edge):
                upper = Node(kid.edge[:n])
                kid.edge = kid.edge[n:]
                upper.kids = {kid.edge[0]: kid}
                kids[key[at]] = kid = upper
            node, at = kid, at + n
        return node

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        stack = [(b"", self.root)]
        while stack:
            head, node = stack.pop()
            whole = head + node.edge
            if node.owner is not None:
                yield whole, node
            for kid in (node.kids or {}).values():
                stack.append((whole, kid))


def _lower(a, b):
    """The smaller of two (id, row) places; null ids come last, None is no place."""
    return b if a is None or (b is not None and _place(b) < _place(a)) else a


def _place(x: tuple) -> tuple:
    return (x[0] is None, x[0] or 0, *x[1:])


_LOCAL = pa.schema([("row", pa.int64()), ("row_id", pa.int64()), ("owner", pa.int64()), ("size", pa.int64()), ("hash", pa.int64()), ("sha", pa.string()), ("body", pa.binary()), ("low", pa.int64()), ("low_row", pa.int64()), ("n", pa.int64())])
_LOCAL_DDL = "row long, row_id long, owner long, size long, hash long, sha string, body binary, low long, low_row long, n long"


def local_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, row_id, hash, sha, body) to the same rows with the owner inside this window: the first row with
    equal bytes. Only the owner's row keeps the body, the place of the smallest id and the count."""
    tries: dict[tuple[int, int], Patricia] = {}
    rows: list[tuple] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        cols: list[list] = [[] for _ in _LOCAL]
        room = 0
        for row, row_id, node, size, h, sha, body in rows:
            own = node.owner == row
            low = node.low if own else (None, None)
            for c, v in zip(cols, (row, row_id, node.owner, size, h, sha, body if own else None, *low, node.count if own else None), strict=True):
                c.append(v)
            room += len(body) if own else 0
            if room > 8 << 20 or len(cols[0]) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _LOCAL, strict=True)], schema=_LOCAL)
                cols, room = [[] for _ in _LOCAL], 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _LOCAL, strict=True)], schema=_LOCAL)
        tries.clear()
        rows.clear()
        held = 0

    for batch in batches:
        places, ids, hashes, shas = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("row", "row_id", "hash", "sha"))
        for a, b, data, off in text_slices(batch, "body", 8 << 20):
            raw, off = data.tobytes(), off.tolist()
            for i in range(a, b):
                body = raw[off[i - a] : off[i - a + 1]]
                key = (len(body), hashes[i])
                node = tries.setdefault(key, Patricia()).terminal(body)
                if node.owner is None:
                    node.owner = places[i]
                    held += len(body)
                else:
                    body = b""
                node.low, node.count = _lower(node.low, (ids[i], places[i])), node.count + 1
                rows.append((places[i], ids[i], node, key[0], hashes[i], shas[i], body))
            if held > SPILL_BYTES or len(rows) > SPILL_ROWS:
                yield from flush()
    yield from flush()


_OWNER = pa.schema([(c, pa.int64()) for c in ("o", "keep", "keep_row", "total")])


def merged_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terminals (owner, size, hash, body, low, low_row, n), sorted by (size, hash), to (owner, keep, keep_row, total): one trie at a time."""
    key, trie, members = None, Patricia(), []
    out: list[list] = [[], [], [], []]

    def close() -> None:
        for owner, node in members:
            for c, v in zip(out, (owner, *node.low, node.count), strict=True):
                c.append(v)

    for batch in batches:
        owners, sizes, hashes, bodies, lows, rows, ns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("owner", "size", "hash", "body", "low", "low_row", "n"))
        for owner, size, h, body, low, row, n in zip(owners, sizes, hashes, bodies, lows, rows, ns, strict=True):
            if (size, h) != key:
                close()
                key, trie, members = (size, h), Patricia(), []
            node = trie.terminal(body)
            node.owner = 0
            node.low, node.count = _lower(node.low, (low, row)), node.count + n
            members.append((owner, node))
        if len(out[0]) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_OWNER)
            out = [[], [], [], []]
    close()
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_OWNER)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; an empty text is a text like any other. Rows are told apart by their place in the input, not by their
    id: of rows with equal texts exactly one is kept, that with the smallest id, null ids last, and among equal ids the one read
    first; keep_id is its id. Further columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    body = F.encode(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " "), "UTF-8")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("row_id"), body.alias("body"))
    rows = rows.select("row", "row_id", F.xxhash64("body").alias("hash"), F.sha2("body", 256).alias("sha"), "body")
    local = materialise(rows.mapInArrow(local_tries, _LOCAL_DDL), "tries")
    terminals = local.where(F.col("n").isNotNull()).select("owner", "size", "hash", "body", "low", "low_row", "n")
    owners = terminals.repartition("size", "hash").sortWithinPartitions("size", "hash").mapInArrow(merged_tries, "o long, keep long, keep_row long, total long")
    out = local.select("row", "row_id", "owner", "sha").join(owners, F.col("owner") == F.col("o"))
    return out.select(
        F.col("row_id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("total").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


_FOLD = re.compile(rb"[\x20\x09-\x0D]+")


def _bodies(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """(row in the batch, normalised text) of column __text."""
    for a, b, data, off in text_slices(batch, "__text", 8 << 20):
        raw, off = data.tobytes(), off.tolist()
        for i in range(a, b):
            yield i, _FOLD.sub(b" ", raw[off[i - a] : off[i - a + 1]])


def local_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to those with the smallest place (__id, __row) of each text in this window, by the tries of the window."""
    tries: dict[int, Patricia] = {}
    held: list[pa.RecordBatch] = []
    best: list[Node] = []
    room = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal room
        stay: dict[int, list[int]] = {}
        for node in best:
            stay.setdefault(node.low[2], []).append(node.low[3])
        for k, batch in enumerate(held):
            if k in stay:
                yield batch.take(pa.array(sorted(stay[k])))
        tries.clear()
        held.clear()
        best.clear()
        room = 0

    for batch in batches:
        ids, rows = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__id", "__row"))
        for i, body in _bodies(batch):
            node = tries.setdefault(len(body), Patricia()).terminal(body)
            if node.owner is None:
                node.owner = 0
                best.append(node)
                room += len(body)
            node.low = _lower(node.low, (ids[i], rows[i], len(held), i))
        held.append(batch)
        room += batch.nbytes
        if room > SPILL_BYTES:
            yield from flush()
    yield from flush()


def merged_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (__size, __hash, __null, __id, __row) to the first of each text: one trie at a time."""
    key, trie = None, Patricia()
    for batch in batches:
        sizes, hashes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__size", "__hash"))
        stay = []
        for i, body in _bodies(batch):
            if (sizes[i], hashes[i]) != key:
                key, trie = (sizes[i], hashes[i]), Patricia()
            node = trie.terminal(body)
            if node.owner is None:
                node.owner = 0
                stay.append(i)
        yield batch.take(pa.array(stay, pa.int64()))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which each group of equal texts keeps exactly one: the row that exact_groups keeps. Rows go through the
    tries as they are, so each text is dealt once and nothing is joined back."""
    spark = docs.sparkSession
    ship(spark)
    names = docs.columns
    body = F.encode(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " "), "UTF-8")
    own = {"__row": F.monotonically_increasing_id(), "__id": F.col(id_col).cast("long"), "__text": F.coalesce(F.col(text_col), F.lit("")), "__size": F.octet_length(body).cast("long"), "__hash": F.xxhash64(body)}
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text_col]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = docs.select(*[v.alias(k) for k, v in own.items()], F.col(text_col).isNull().alias("__none"), *rest)
    ddl = rows.schema
    first = rows.mapInArrow(local_first, ddl)
    dealt = first.repartition("__size", "__hash").sortWithinPartitions("__size", "__hash", F.col("__id").isNull(), "__id", "__row")
    out = dealt.mapInArrow(merged_first, ddl)
    text = F.when(~F.col("__none"), F.col("__text")).cast(kinds[text_col])
    return out.select(*[text.alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLES = {
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM t"""
}
