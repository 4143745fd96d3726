"""Ranked lexical search with block-max pruning over a forward index.

The index is a table of blocks. A block is a range of consecutive documents: their ids and lengths, its distinct terms (64-bit hashes, sorted), for each term
the largest gain of any of its documents and the number of documents that hold it, and the forward index: for each document its terms, as numbers in the
block, with their counts. A term's gain in a document, (10^9 tf) div (1000 tf + 8 m), does not depend on the query or on how common the term is, so a
block's maxima are exact and serve every query: the sum over a query's terms of weight times maximum bounds the score of each of its documents.

A search reads the maxima first: document frequencies, then each query's blocks of the highest bound. Those are scored, and their tenth best score is the
query's threshold. The last pass goes over the blocks of each batch by falling bound and scores a block for those queries alone whose bound still reaches their
threshold, which rises as better documents are found; a bound equal to it is scored too, since ties go by id. Nothing is cut off: a document that is not scored
has a bound below ten others' scores.

Queries go in groups of at most CELLS term-by-query weights, so what is broadcast and what a task holds is bounded for any number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.llm import textvec as tv
from evidra.llm.common import materialise, ship, text_slices

#: Results of a query; documents and index entries of a block at most; blocks a query scores for its first threshold; weights of a group of queries.
TOP, BLOCK_DOCS, BLOCK_ENTRIES, FIRST, CELLS = 10, 32, 1 << 15, 2, 4 << 20
#: A block has some 100 KB, up to 1 MB: rows of an Arrow batch of them, and the writer's options for small row groups, which a reader holds whole.
INDEX_ROWS = 16
SMALL_GROUPS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 8}
#: [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]: digits, ASCII letters, everything beyond ASCII.
IS_TERM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    IS_TERM[_low : _high + 1] = True
#: Stands for a null id, after all others among equal scores.
_NO_ID = np.iinfo(np.int64).max


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts and where each text's begin."""
    s, e, first = tv.words(data, offsets, IS_TERM)
    return (tv.word_hashes(tv.LOWER[data], s, e) if len(s) else np.zeros(0, np.uint64)), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for _, _, data, off in text_slices(batch, "text", 4 << 20):
            n = np.diff(tv.words(data, off, IS_TERM)[2])
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], names=["docs", "terms"])


def gain(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    m = 25 + (75 * n * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


_PARTS = ("ids", "lengths", "terms", "most", "holders", "begin", "local", "tf")
_BLOCK = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in _PARTS)])


def _block(hashes: np.ndarray, first: np.ndarray, ids: np.ndarray, docs: int, terms: int) -> list[bytes]:
    """The parts of a block of documents that all have terms; hashes[first[i] : first[i + 1]] are those of document i."""
    n = np.diff(first)
    known, local = np.unique(hashes, return_inverse=True)
    key, tf = np.unique(np.repeat(np.arange(len(n)), n) * len(known) + local, return_counts=True)
    owner, local = key // len(known), key % len(known)
    most = np.zeros(len(known), np.int64)
    np.maximum.at(most, local, gain(tf.astype(np.int64), n[owner].astype(np.int64), docs, terms))
    holders = np.bincount(local, minlength=len(known))
    begin = np.searchsorted(owner, np.arange(len(n) + 1))
    small = (np.int64, np.int64, np.uint64, np.int32, np.int32, np.int32, np.int32, np.int32)
    return [x.astype(t).tobytes() for x, t in zip((ids, n, known, most, holders, begin, local, tf), small, strict=True)]


def _index(docs: int, terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("row_id")).fill_null(_NO_ID).to_numpy()
            for a, b, data, off in text_slices(batch, "text", 1 << 20):
                hashes, first = term_hashes(data, off)
                some = np.flatnonzero(np.diff(first) > 0)
                edge = np.append(first[some], len(hashes))
                out, i = [], 0
                while i < len(some):
                    j = min(i + BLOCK_DOCS, len(some), max(i + 1, int(np.searchsorted(edge, edge[i] + BLOCK_ENTRIES, "right")) - 1))
                    out.append([number, *_block(hashes[edge[i] : edge[j]], edge[i : j + 1] - edge[i], rows[a + some[i:j]], docs, terms)])
                    number, i = number + 1, j
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _BLOCK, strict=True)], schema=_BLOCK)

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """(index, N, L): the blocks as a written table, the number of documents with a term and of all their terms.

    Null, empty and termless texts are in no block. Ids may repeat (each row is a document of its own) or be null (last among equal scores). A text of any
    length is one document; it alone may exceed BLOCK_ENTRIES.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    n, terms = rows.select("text").mapInArrow(_count, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return materialise(rows.mapInArrow(_index(n, terms), "block long, " + ", ".join(f"{c} binary" for c in _PARTS)), "lexical", **SMALL_GROUPS), n, terms


class Queries:
    """A group of queries: their ids, the sorted hashes of their terms and how often each query has each term."""

    def __init__(self, items: list[tuple[object, np.ndarray]]) -> None:
        self.items = [i for i, _ in items]
        self.known = np.unique(np.concatenate([h for _, h in items]))
        self.count = np.zeros((len(self.known), len(items)))
        for q, (_, h) in enumerate(items):
            np.add.at(self.count[:, q], np.searchsorted(self.known, h), 1)
        self.least = np.ones(len(items))
        self.weight = np.zeros(len(self.known))

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of a block's terms are known here, and as what."""
        at = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == terms)
        return hit, at[hit]


def groups(items: Iterator[tuple[object, str]], cells: int = CELLS) -> Iterator[Queries]:
    """Queries with terms, in order, as many at a time as cells allow."""
    held: list[tuple[object, np.ndarray]] = []
    known: set[int] = set()
    for item, text in items:
        raw = np.frombuffer(text.encode(), np.uint8)
        h, _ = term_hashes(raw, np.array([0, len(raw)]))
        if not len(h):
            continue
        if held and (len(known | set(h.tolist()))) * (len(held) + 1) > cells:
            yield Queries(held)
            held, known = [], set()
        held.append((item, h))
        known |= set(h.tolist())
    if held:
        yield Queries(held)


def _arrays(batch: pa.RecordBatch, row: int, names: tuple[str, ...]) -> list[np.ndarray]:
    kinds = dict(zip(_PARTS, (np.int64, np.int64, np.uint64, np.int32, np.int32, np.int32, np.int32, np.int32), strict=True))
    return [np.frombuffer(batch.column(batch.schema.get_field_index(c))[row].as_buffer(), kinds[c]) for c in names]


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        df = np.zeros(len(q.known), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                terms, holders = _arrays(batch, r, ("terms", "holders"))
                hit, at = q.places(terms)
                df[at] += holders[hit]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], names=["term", "df"])

    return run


def _bounds(q: Queries, terms: np.ndarray, most: np.ndarray) -> np.ndarray:
    hit, at = q.places(terms)
    return (most[hit] * q.weight[at]) @ q.count[at]


def _highest(shared, first: int):
    """Each query's blocks of the highest bound in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best = np.zeros((first, len(q.items)))
        where = np.zeros((first, len(q.items)), np.int64)
        for batch in batches:
            blocks = batch.column(batch.schema.get_field_index("block")).to_numpy()
            bound = np.array([_bounds(q, *_arrays(batch, r, ("terms", "most"))) for r in range(batch.num_rows)]).reshape(-1, len(q.items))
            best, where = np.vstack([best, bound]), np.vstack([where, np.repeat(blocks[:, None], len(q.items), 1)])
            order = np.argsort(-best, axis=0, kind="stable")[:first]
            best, where = np.take_along_axis(best, order, 0), np.take_along_axis(where, order, 0)
        k, item = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(where[k, item], pa.int64()), pa.array(best[k, item], pa.float64())], names=["query", "block", "bound"])

    return run


def _scores(q: Queries, batch: pa.RecordBatch, row: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores (documents x live queries) of a block. Scores are whole numbers below 2^53, so doubles hold them exactly."""
    ids, lengths, terms, begin, local, tf = _arrays(batch, row, ("ids", "lengths", "terms", "begin", "local", "tf"))
    hit, at = q.places(terms)
    column = np.full(len(terms), -1)
    column[hit] = np.arange(len(hit))
    column = column[local]
    mine = column >= 0
    owner = np.repeat(np.arange(len(ids)), np.diff(begin))[mine]
    table = np.zeros((len(ids), len(hit)))
    table[owner, column[mine]] = gain(tf[mine].astype(np.int64), lengths[owner], q.docs, q.terms)
    return ids, table @ (q.weight[at, None] * q.count[at][:, live])


def _search(shared, top: int, chosen=None):
    """The best documents of each query among a task's blocks. With chosen (block -> queries) those are scored alone, and no bound is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        least = q.least.copy()
        found: list[np.ndarray] = []
        held = 0

        def best() -> np.ndarray:
            rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
            start = np.searchsorted(rows[:, 0], np.arange(len(q.items) + 1))
            rank = np.arange(len(rows)) - start[rows[:, 0]]
            full = np.flatnonzero(np.diff(start) >= top)
            least[full] = np.maximum(least[full], rows[start[full] + top - 1, 1])
            return rows[rank < top]

        for batch in batches:
            if chosen is None:
                bound = np.array([_bounds(q, *_arrays(batch, r, ("terms", "most"))) for r in range(batch.num_rows)]).reshape(-1, len(q.items))
                order = np.argsort(-(bound / np.maximum(least, 1)).max(axis=1, initial=0), kind="stable")
            else:
                blocks = batch.column(batch.schema.get_field_index("block")).to_pylist()
                order = np.arange(batch.num_rows)
            for r in order:
                live = np.flatnonzero(bound[r] >= least) if chosen is None else np.array(chosen.value.get(blocks[r], []), np.int64)
                if not len(live):
                    continue
                ids, score = _scores(q, batch, r, live)
                doc, item = np.nonzero(score >= least[live])
                if len(doc):
                    found.append(np.stack([live[item], score[doc, item].astype(np.int64), ids[doc]], 1))
                    held += len(doc)
                    if held > 4 * top * len(q.items):
                        found[:] = [best()]
                        held = len(found[0])
        rows = best()
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, i], pa.int64()) for i in range(3)], names=["query", "score", "row_id"])

    return run


_FOUND = "query long, score long, row_id long"


def search(index: DataFrame, docs: int, terms: int, queries: DataFrame, item_col: str = "item_id", item_text: str = "text", top: int = TOP, cells: int = CELLS, first: int = FIRST) -> DataFrame:
    """item_id, rank, row_id, score: for each row of queries its top documents of index, the highest score first, equal scores by ascending id.

    Only documents with a score above 0 count; a query has fewer results, or none, if there are no more. Null and termless queries have none. Items
    that repeat are answered each for itself, under the same id. docs and terms are what build_index gave.
    """
    spark = index.sparkSession
    ship(spark)
    # until another operator runs, so for the result's plan, too
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(INDEX_ROWS))
    sc = spark.sparkContext
    kind = queries.schema[item_col].dataType.simpleString()
    lines = ((r[0], r[1]) for r in queries.where(F.col(item_text).isNotNull()).select(item_col, item_text).toLocalIterator())
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for q in groups(lines, cells):
        q.docs, q.terms = docs, terms
        df = index.select("terms", "holders").mapInArrow(_frequencies(sc.broadcast(q)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        counted = np.zeros(len(q.known))
        for r in df.collect():  # at most the terms of a group of queries
            counted[r["term"]] = r["df"]
        q.weight = np.floor(1000 * np.log((2 * docs + 2) / (2 * counted + 1)))
        shared = sc.broadcast(q)
        near = index.select("block", "terms", "most").mapInArrow(_highest(shared, first), "query long, block long, bound double")
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))).where(F.col("r") <= first)
        chosen: dict[int, list[int]] = {}
        for r in near.collect():  # at most first blocks a query
            chosen.setdefault(r["block"], []).append(r["query"])
        by_score = Window.partitionBy("query").orderBy(F.desc("score"), "row_id")
        hits = index.where(F.col("block").isin(list(chosen))).mapInArrow(_search(shared, top, sc.broadcast(chosen)), _FOUND)
        for r in hits.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == top).collect():
            q.least[r["query"]] = r["score"]
        hits = index.mapInArrow(_search(sc.broadcast(q), top), _FOUND).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(q.items)], f"query long, item_id {kind}")
        row = F.when(F.col("row_id") != int(_NO_ID), F.col("row_id"))
        out = out.unionAll(hits.join(F.broadcast(names), "query").select("item_id", "rank", row.alias("doc_id"), "score"))
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, docs, terms = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, docs, terms, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op13_lexical_search": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
        n AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
        total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
        q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
        tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
        wt AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
               FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
        s AS (SELECT q.item_id, n.doc_id, n.r, CAST(sum(q.c * wt.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n.n * docs) // terms)))) AS BIGINT) AS score
              FROM q JOIN tf ON q.term = tf.term JOIN wt ON q.term = wt.term JOIN n ON tf.r = n.r, total GROUP BY q.item_id, n.doc_id, n.r),
        k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {TOP}"""
}
