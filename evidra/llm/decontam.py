"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark windows.

Normalising works on UTF-8 bytes: A-Z become a-z, every byte outside the word class becomes a space, and words are
joined by single spaces with one in front and one behind. A benchmark window is a run of words in that form, so a match
of the automaton is a run of whole words; its place in the normalised text gives word numbers, and the words' places in
the original give offsets. The benchmark is read in blocks of at most BLOCK_BYTES of windows; each block is one automaton, built once per
Python worker from a broadcast list, and each text is scanned once per block (public benchmarks fit in one block).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import filter_rows, materialise, ship, text_slices

WINDOW = 10
#: Bytes of windows in one automaton; a node takes some 30 bytes, so a block stays under about 150 MB a worker.
BLOCK_BYTES = 4 << 20
#: Blocks that texts pass before they are written down: each block of a chain has its own workers.
CHAIN = 3

_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_RUN = re.compile(rb"[^ ]+")


def word_list(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def windows(raw: bytes, size: int = WINDOW) -> set[bytes]:
    """An item's windows in normalised form."""
    w = word_list(raw)
    if not w:
        return set()
    return {b" " + b" ".join(w[i : i + size]) + b" " for i in range(max(1, len(w) - size + 1))}


def blocks(items: Iterator[tuple[str, bytes]], size: int, limit: int) -> Iterator[dict[bytes, list[str]]]:
    """Windows with the ids of the items that have them, at most limit bytes at a time, an item's windows together
    unless the item alone is larger."""
    block: dict[bytes, list[str]] = {}
    held = 0
    for item, raw in items:
        for w in windows(raw, size):
            if w not in block:
                held += len(w)
            block.setdefault(w, []).append(item)
        if held > limit:
            yield block
            block, held = {}, 0
    if block:
        yield block


_built: dict[str, ahocorasick.Automaton] = {}


def automaton(key: str, block: dict[bytes, list[str]]) -> ahocorasick.Automaton:
    if key not in _built:
        _built.clear()
        auto = ahocorasick.Automaton()
        for w, items in block.items():
            auto.add_word(w.decode("latin-1"), (len(w), w.count(b" ") - 1, items))
        auto.make_automaton()
        _built[key] = auto
    return _built[key]


def scan(auto: ahocorasick.Automaton, raw: bytes) -> tuple[int, list[tuple[int, int]], set[str], int]:
    """Words of a text, its hit word runs (first, end), the items found, and hit words."""
    w = raw.translate(_TABLE).split()
    if not w:
        return 0, [], set(), 0
    norm = f" {b' '.join(w).decode('latin-1')} "
    runs: list[tuple[int, int]] = []
    items: set[str] = set()
    at = words = 0
    for end, (length, count, owners) in auto.iter(norm):
        first = end + 1 - length
        # matches come by end; one that begins before the last counted place is found by counting back
        if first >= at:
            words += norm.count(" ", at, first)
        else:
            words -= norm.count(" ", first, at)
        at = first
        items.update(owners)
        runs.append((words, words + count))
    merged: list[list[int]] = []
    for a, b in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return len(w), [(a, b) for a, b in merged], items, sum(b - a for a, b in merged)


def original_spans(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word runs as (start, end) code points of the original text; the text is walked once."""
    at = [m.span() for m in _RUN.finditer(raw.translate(_TABLE))]
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=points[1:])
    return [(int(points[at[a][0]]), int(points[at[b - 1][1]])) for a, b in runs]


_LISTS = "runs array<array<long>>, spans array<array<long>>, items array<string>"
_OUT_ARROW = [("n_words", pa.int64()), *((c, pa.list_(pa.list_(pa.int64()))) for c in ("runs", "spans")), ("items", pa.list_(pa.string()))]


def union_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scanner(key: str, shared, first: bool, last: bool):
    """Rows (row_id, text and, but for the first block, n_words, runs, items) with what this block adds; the last block gives spans and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(key, shared.value)
        for batch in batches:
            ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("row_id", "text"))
            for a, b, data, off in text_slices(batch, "text", 8 << 20):
                raw, off = data.tobytes(), off.tolist()
                before = [[None] * (b - a)] * 2 if first else [batch.column(batch.schema.get_field_index(c)).slice(a, b - a).to_pylist() for c in ("runs", "items")]
                cols: list[list] = [[], [], [], []]
                for i in range(b - a):
                    text = raw[off[i] : off[i + 1]]
                    n, runs, items, _ = scan(auto, text)
                    if before[0][i]:
                        runs = union_runs([*runs, *map(tuple, before[0][i])])
                    if before[1][i]:
                        items |= set(before[1][i])
                    for c, v in zip(cols, (n, runs, original_spans(text, runs) if runs and last else [], sorted(items)), strict=True):
                        c.append(v)
                made = [pa.array(c, t) for c, (_, t) in zip(cols, _OUT_ARROW, strict=True)]
                names = ["row_id", *([] if last else ["text"]), *(n for n, _ in _OUT_ARROW)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *([] if last else [texts.slice(a, b - a)]), *made], names=names)

    return run


def _benchmark_blocks(spark: SparkSession, benchmark: DataFrame, item_col: str, item_text: str, size: int, block_bytes: int) -> Iterator[tuple[str, object]]:
    """(key, broadcast windows) of each block; at least one. The driver holds one block at a time."""
    lines = benchmark.where(F.col(item_text).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("string"), F.col(item_text))
    none = True
    for block in blocks(((r[0], r[1].encode()) for r in lines.toLocalIterator()), size, block_bytes):
        none = False
        yield hashlib.sha256(repr(sorted(block.items())).encode()).hexdigest(), spark.sparkContext.broadcast(block)
    if none:
        yield "none", spark.sparkContext.broadcast({b" \xff\xff ": []})


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: row_id, n_words, runs (hit word runs), spans (the same in code points of the original),
    items (ids, as text, of the items found, sorted).

    Null and wordless texts have no words and no hits. Items without words or id never match. Items that share a window are all
    found. An empty benchmark finds nothing. Ids may repeat or be null: rows pass through the blocks one after another, each
    adding to what the ones before have found, and nothing is shuffled or grouped.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    parts = list(_benchmark_blocks(spark, benchmark, item_col, item_text, size, block_bytes))
    for i, (key, shared) in enumerate(parts):
        last = i == len(parts) - 1
        rows = rows.mapInArrow(_scanner(key, shared, not i, last), f"row_id long, {'' if last else 'text string, '}n_words long, {_LISTS}")
        if i % CHAIN == CHAIN - 1 and not last:
            rows = materialise(rows, "scanned")
    return rows


def hit_counts(found: DataFrame) -> DataFrame:
    """find_benchmark's rows with n_hit, n_items, items_sha256 and contaminated."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0])
    return found.select(
        "*",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, without those that hold a benchmark window. Rows pass the blocks as they are, without a shuffle; ids
    may repeat or be null. Null texts stay."""
    spark = docs.sparkSession
    ship(spark)

    def clean(key: str, shared):
        def judge(batch: pa.RecordBatch, text: str) -> np.ndarray:
            auto = automaton(key, shared.value)
            out = []
            for _, _, data, off in text_slices(batch, text, 8 << 20):
                raw, off = data.tobytes(), off.tolist()
                for x, y in zip(off[:-1], off[1:], strict=True):
                    w = raw[x:y].translate(_TABLE).split()
                    out.append(not w or next(auto.iter(f" {b' '.join(w).decode('latin-1')} "), None) is None)
            return np.array(out, bool)

        return judge

    parts = list(_benchmark_blocks(spark, benchmark, item_col, item_text, size, block_bytes))
    for i, (key, shared) in enumerate(parts):
        docs = filter_rows(docs, text_col, {}, clean(key, shared))
        if i % CHAIN == CHAIN - 1 and i < len(parts) - 1:
            docs = materialise(docs, "scanned")
    return docs


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hit_counts(found).select(F.col("row_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op8_benchmark_decontamination": rf"""
        WITH d AS (SELECT doc_id, coalesce({_WORDS}, CAST([] AS VARCHAR[])) AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
        k AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), ' ') AS win
              FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT k FROM k),
        p AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
              FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
        h AS (SELECT p.doc_id, p.k, p.i, k.item_id FROM p JOIN k ON p.k = k.k AND p.win = k.win),
        hw AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
        hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id"""
}
