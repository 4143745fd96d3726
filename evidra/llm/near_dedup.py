"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

1. Each whole text becomes the set of its distinct 5-word shingles (64-bit hashes), a 128-bit fingerprint of the set, a parity
   sketch and a SuperMinHash signature: element d draws a permutation p of the m slots and values j + r_j, and slot p_j keeps the
   least. Level j can only lower slots whose value is above j, so a text stops at the first level at which no slot is.
2. Documents with equal sets form a class; only its smallest id goes on. Copies never meet again.
3. ROWS of BANDS slots give a bucket each. With 36 bands of 4, a pair at similarity 0.75 shares a bucket with probability
   1 - 1.1e-6, a pair at 0.9 always but once in 10^16.
4. In each bucket every class is checked against the smallest one, on full sets. Links are united.
5. Where a bucket still holds several components, its rows are checked against the smallest of random parts of it, then all pairs across
   components that nothing rules out. Large buckets are cut into blocks and pairs of blocks, so that no task holds one.
6. Components over all links; classes give their component to their copies.

What rules a pair out is exact. Sizes: the smaller set has at least 0.75 of the larger one. The parity sketch: a bit tells whether an odd
number of the set's elements hash to it, so bits that differ are no more than elements that are in one set only, and two linked sets
have at most a seventh of both sizes of those. And the shingles that a document shares with any other document of such buckets
bound every intersection of it.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import textvec as tv
from evidra.llm.common import ARROW_ROWS, drop_scratch, materialise, ship, text_slices
from evidra.llm.components import components

WORDS, PERCENT = 5, 75
BANDS, ROWS = 36, 4
M = BANDS * ROWS
#: 64-bit words of a parity sketch.
SKETCH = 32
#: Random parts of a bucket in the second round of stars, and the rows of a bucket that one task compares with as many others.
PARTS, CELL = (8, 64, 512), 1024
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after another, and where each text's begin."""
    data = tv.LOWER[data]
    s, e, first = tv.words(data, offsets)
    sh, begin = tv.shingle_hashes(tv.word_hashes(data, s, e), first, k)
    sets = [np.unique(sh[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
    count = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(x) for x in sets], out=count[1:])
    return np.concatenate(sets) if sets else np.zeros(0, _U), count


def _rand(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tv.mix(h + _U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def superminhash(elements: np.ndarray, begin: np.ndarray, m: int = M) -> np.ndarray:
    """SuperMinHash signatures, a row of m for each set: level in the high bits, the 48-bit value r below."""
    n = len(begin) - 1
    sig = np.full(n * m, _U((1 << 64) - 1))
    size = np.diff(begin)
    owner = np.repeat(np.arange(n), size)
    # level 0 needs no permutation: the slot is the draw itself
    r = _rand(elements, 0)
    np.minimum.at(sig, owner * m + ((r >> _U(40)) % _U(m)).astype(np.int64), r & _U((1 << 48) - 1))
    sig = sig.reshape(n, m)
    open_sets = np.flatnonzero((size > 0) & (sig.max(1) >= _U(1 << 48)))
    # the sets that level 0 leaves open are small; take them together, some thousands of elements at a time
    at = 0
    while at < len(open_sets):
        stop, total = at, 0
        while stop < len(open_sets) and (stop == at or total + size[open_sets[stop]] <= 16_384):
            total += int(size[open_sets[stop]])
            stop += 1
        some = open_sets[at:stop]
        at = stop
        el = np.concatenate([elements[begin[i] : begin[i + 1]] for i in some])
        own = np.repeat(some, size[some])
        perm = np.tile(np.arange(m, dtype=np.int16), (len(el), 1))
        rows = np.arange(len(el))
        for level in range(m):
            r = _rand(el, level)
            k = level + ((r >> _U(40)) % _U(m - level)).astype(np.int64)
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, level]
            if level:
                np.minimum.at(sig.reshape(-1), own * m + slot, (r & _U((1 << 48) - 1)) | _U(level << 48))
                done = sig.max(1)
                live = (done[own] >> _U(48)) > _U(level)
                if not live.all():
                    el, own, perm = el[live], own[live], perm[live]
                    rows = np.arange(len(el))
            if not len(el):
                break
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket of each band; rows are sets."""
    out = np.zeros((len(sig), bands), _U)
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = tv.mix(out * _U(0xFF51AFD7ED558CCD) + sig[:, j::rows][:, :bands])
        return tv.mix(out + np.arange(1, bands + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def parity_sketch(elements: np.ndarray, begin: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """A row of words 64-bit words for each set: the parity of the number of its elements at each bit."""
    bits, n = words * 64, len(begin) - 1
    at = np.repeat(np.arange(n), np.diff(begin)) * bits + (_rand(elements, 303) % _U(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1, bitorder="little").view("<i8")


_SIG = pa.schema([("row_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
_SIG_DDL = "row_id long, n long, f1 long, f2 long, keys array<long>, sketch array<long>"


def _lists(full: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """A list of values' row for each full set, an empty one for the others."""
    ends = np.concatenate([[0], np.cumsum(full * values.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[full].ravel()))


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, text) to (row_id, set size, fingerprint, bucket of each band, parity sketch; empty lists for empty sets)."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("row_id"))
        for a, b, data, off in text_slices(batch, "text", 1 << 20):
            el, begin = shingle_sets(data, off)
            sig = superminhash(el, begin)
            keys = band_keys(sig).view(np.int64)
            n = np.diff(begin)
            prints = []
            for salt in (101, 202):
                total = np.zeros(len(el) + 1, _U)
                np.cumsum(_rand(el, salt), out=total[1:])
                prints.append((total[begin[1:]] - total[begin[:-1]]).view(np.int64))
            full = n > 0
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n), pa.array(prints[0]), pa.array(prints[1]), _lists(full, keys), _lists(full, parity_sketch(el, begin))], schema=_SIG)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("inter", pa.int64()), ("total", pa.int64())])


def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to sizes of intersection and union of the full sets. Sets are kept for repeated ids."""
    kept: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
    held = 0

    def the_set(i: int, text: str) -> np.ndarray:
        nonlocal held
        key = (i, hash(text))
        got = kept.get(key)
        if got is None:
            raw = np.frombuffer(text.encode(), np.uint8)
            got = kept[key] = shingle_sets(raw, np.array([0, len(raw)], np.int64))[0]
            held += len(got)
            while held > 2 << 20 and len(kept) > 2:
                held -= len(kept.popitem(last=False)[1])
        else:
            kept.move_to_end(key)
        return got

    for batch in batches:
        a, b, ta, tb = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "text_a", "text_b"))
        a, b = a.to_pylist(), b.to_pylist()
        inter, total = [], []
        for i in range(len(a)):
            x, y = the_set(a[i], ta[i].as_py()), the_set(b[i], tb[i].as_py())
            n = len(np.intersect1d(x, y, assume_unique=True))
            inter.append(n)
            total.append(len(x) + len(y) - n)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, inter, total)], schema=_LINK)


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    joined = pairs.join(texts.select(F.col("row_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("row_id").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(overlaps, "a long, b long, inter long, total long")


def _near() -> F.Column:
    return F.col("inter") * 100 >= F.col("total") * PERCENT


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Null, empty and white-space texts have no shingles and are linked with nothing. Rows with a null id are linked with nothing:
    component_id null, kept. Rows that share an id are one document with several texts: a link of any text is a link of the
    id, each row has its own n_shingles, and all of them are kept or none. Further columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    sigs = materialise(rows.mapInArrow(signatures, _SIG_DDL), "signatures")
    # classes of equal sets, folded in each task before the shuffle
    sets = ["n", "f1", "f2"]
    full = F.col("n") > 0
    known = full & F.col("row_id").isNotNull()
    copies = sigs.where(known).groupBy(*sets).agg(F.min("row_id").alias("cls"), F.count("*").alias("c")).where("c > 1").drop("c")
    cls = F.when(F.col("row_id").isNotNull(), F.coalesce("cls", "row_id")).alias("cls")
    member = materialise(sigs.select("row_id", *sets).join(copies, sets, "left").select("row_id", *sets, cls), "classes")
    gone = member.where("row_id <> cls").select("row_id", *sets)
    heads = materialise(sigs.where(known).join(gone, ["row_id", *sets], "left_anti").dropDuplicates(["row_id", *sets]), "heads")
    drop_scratch(sigs)
    buckets = heads.select("row_id", "n", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("size"), F.min("row_id").alias("head")).where("size > 1")
    crowd = materialise(buckets.join(shared, "key").select("key", "head", "row_id", "n"), "buckets")
    ids = crowd.select("row_id").distinct()
    texts = materialise(rows.join(ids, "row_id", "left_semi").distinct(), "candidates")
    stars = crowd.where("row_id <> head").select(F.col("head").alias("a"), F.col("row_id").alias("b")).distinct()
    tested = materialise(_checked(_possible(stars, heads), texts), "tested")
    # an id with texts of several classes joins these
    several = member.groupBy("row_id").agg(F.min("cls").alias("c0"), F.max("cls").alias("c1")).where("c0 <> c1").select("row_id")
    joined = member.join(several, "row_id").select(F.col("row_id").alias("a"), F.col("cls").alias("b")).distinct()
    links = tested.where(_near()).select("a", "b").unionAll(materialise(joined, "joined"))
    roots = materialise(components(links), "roots")

    # what the heads leave apart: stars of random parts of each bucket, then all pairs across components
    mixed = _mixed(crowd, roots)
    bounds = _shared(mixed, texts)
    mixed = materialise(mixed.join(bounds, "row_id").where(_may_link()), "mixed")
    for pairs in (_part_stars, lambda m: _across(m, heads)):
        some = pairs(_mixed(mixed.drop("root", "size"), roots)).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
        more = materialise(_checked(_possible(some, heads), texts), "tested")
        links = links.unionAll(more.where(_near()).select("a", "b"))
        roots = materialise(components(links), "roots")
        tested = tested.unionAll(more)
    result = member.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("row_id", "n", F.coalesce("root", "cls").alias("component_id"))
    for x in (crowd, texts, mixed, heads):
        drop_scratch(x)
    return result.select(F.col("row_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("row_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _sizes(p: str, q: str) -> F.Column:
    """Exact: the smaller of two linked sets has at least 0.75 of the larger one's size."""
    return F.least(p, q) * 100 >= F.greatest(p, q) * PERCENT


def _alike(x: str, y: str) -> F.Column:
    """Exact: bits that differ are elements of one set only, of which linked sets of s elements together have at most s / 7."""
    differ = sum(F.bit_count(F.get(f"{x}sketch", F.lit(i)).bitwiseXOR(F.get(f"{y}sketch", F.lit(i)))) for i in range(SKETCH))
    return differ * (100 + PERCENT) <= (F.col(f"{x}n") + F.col(f"{y}n")) * (100 - PERCENT)


def _possible(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs (a, b) that neither sizes nor sketches rule out."""
    x, y = (heads.select(F.col("row_id").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").where(_sizes("a_n", "b_n") & _alike("a_", "b_")).select("a", "b").distinct()


def _may_link() -> F.Column:
    """A link of x has at least 0.75 |union| >= 0.75 |x| common shingles."""
    return F.col("common") * 100 >= F.col("n") * PERCENT


def _mixed(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with their component and the bucket's size."""
    placed = crowd.join(roots, F.col("row_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "row_id")).drop("node")
    spread = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")).where("r0 <> r1").select("key", "size")
    return materialise(placed.join(spread, "key").drop("head"), "mixed")


_ELEMENT = pa.schema([("row_id", pa.int64()), ("element", pa.int64())])


def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, text) to a row for each distinct shingle."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("row_id")).to_numpy()
        for a, b, data, off in text_slices(batch, "text", 1 << 18):
            el, begin = shingle_sets(data, off)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:b], np.diff(begin))), pa.array(el.view(np.int64))], schema=_ELEMENT)


def _shared(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """For each document of the mixed buckets, how many of its shingles another of these documents has."""
    some = texts.join(mixed.select("row_id").distinct(), "row_id", "left_semi").select("row_id", "text")
    lone = some.mapInArrow(elements, "row_id long, element long").groupBy("element").agg(F.count("*").alias("c"), F.min("row_id").alias("row_id"))
    lone = lone.where("c = 1").groupBy("row_id").agg(F.count("*").alias("lone"))
    size = mixed.groupBy("row_id").agg(F.max("n").alias("most"))
    return materialise(size.join(lone, "row_id", "left").select("row_id", (F.col("most") - F.coalesce("lone", F.lit(0))).alias("common")), "bounds")


def _part_stars(mixed: DataFrame) -> DataFrame:
    """Each row with the smallest of its part of the bucket, for parts of several sizes, where the components differ."""
    pairs = None
    for parts in PARTS:
        row = mixed.where(F.col("size") > parts).select("key", "row_id", "root", F.pmod(F.xxhash64("row_id", F.lit(parts)), F.lit(parts)).alias("part"))
        first = row.groupBy("key", "part").agg(F.min(F.struct("row_id", "root")).alias("first"))
        got = row.join(first, ["key", "part"]).where("first.root <> root").select(F.col("first.row_id").alias("a"), F.col("row_id").alias("b"))
        pairs = got if pairs is None else pairs.unionAll(got)
    return pairs


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def across_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, low, high), the cells of buckets, to the pairs (a < b) across components of a cell that sizes, common shingles and
    sketches leave possible. At most one cell and a batch are held."""
    held: list[pa.RecordBatch] = []

    def pairs(table: pa.Table) -> pa.RecordBatch:
        col = {c: table[c].to_numpy() for c in ("key", "low", "high", "block", "row_id", "root", "n", "common")}
        sketch = table["sketch"].combine_chunks().flatten().to_numpy().view(_U).reshape(-1, SKETCH)
        new = np.ones(table.num_rows, bool)
        for c in ("key", "low", "high"):
            new[1:] &= col[c][1:] == col[c][:-1]
        new[0] = False
        cell = np.cumsum(~new)
        n, common, root, block, row = (col[c] for c in ("n", "common", "root", "block", "row_id"))
        inner = col["low"] == col["high"]
        found = []
        for d in range(1, int(np.bincount(cell).max())):
            x = np.flatnonzero((cell[:-d] == cell[d:]) & (root[:-d] != root[d:]))
            y = x + d
            x = x[(inner[x] | (block[x] != block[y])) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * PERCENT)]
            y = x + d
            # intersection >= 75 / 175 of both sizes together
            x = x[np.minimum(common[x], common[y]) * (100 + PERCENT) >= (n[x] + n[y]) * PERCENT]
            y = x + d
            differ = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64)
            x = x[differ * (100 + PERCENT) <= (n[x] + n[y]) * (100 - PERCENT)]
            found.append(np.stack([row[x], row[x + d]]))
        got = np.sort(np.concatenate(found, 1), 0) if found else np.zeros((2, 0), np.int64)
        got = np.unique(got[:, got[0] != got[1]], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], schema=_PAIRS)

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) < 4 * ARROW_ROWS:
            continue
        table = pa.Table.from_batches(held)
        last = [table[c][-1] for c in ("key", "low", "high")]
        mask = np.ones(table.num_rows, bool)
        for c, v in zip(("key", "low", "high"), last, strict=True):
            mask &= table[c].to_numpy() == v.as_py()
        cut = int(np.argmax(mask))  # where the last cell begins
        if cut:
            yield pairs(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held and sum(x.num_rows for x in held):
        yield pairs(pa.Table.from_batches(held))


def _across(mixed: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs across components of a bucket that nothing rules out. A bucket of more than CELL rows is cut into blocks, and each pair of
    blocks is a cell of its own."""
    blocks = F.ceil(F.col("size") / CELL).cast("int")
    rows = mixed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    rows = rows.join(heads.select("row_id", "n", "sketch"), ["row_id", "n"]).select("key", "low", "high", "block", "row_id", "root", "n", "common", "sketch")
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(across_pairs, "a long, b long")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which each group of near duplicates keeps the smallest id. Rows with a null id stay."""
    gone = near_groups(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("__gone"))
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLES: dict[str, str] = {}
