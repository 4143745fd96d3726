"""Token ids in blocks with Elias-Fano document boundaries.

A token file is a Parquet dataset of blocks (Parquet, so that every store Spark can write takes it). A block holds
consecutive documents in ascending id order:

    part, seq                        place in the global order: range partition, block inside it
    n_docs, n_ids, part_docs, part_ids   sizes, and what lies before the block inside its part
    low_id                           smallest document id of the block (0 if all are null)
    n_null                           leading documents without an id
    doc_ids                          Elias-Fano of the ids less low_id
    bounds                           Elias-Fano of the documents' end positions in ids
    ids                              little-endian unsigned 16-bit ids (32-bit if the vocabulary needs it)

Elias-Fano of n non-decreasing values below u: n low parts of l = floor(log2(u/n)) bits, packed, and the high parts in
unary as a bit vector of n + u/2^l bits at most; 2 + log2(u/n) bits a value. select(i) finds the i-th set bit with one
sampled directory entry per 512 ones (a 32-bit byte number and a rest) and popcounts from there; readers take all offsets from it.

Added tokens of the tokenizer are found in the text, as its plain call with add_special_tokens=False does.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import textvec
from evidra.llm.common import scratch_path, ship, text_slices

#: A block closes at so many ids or documents.
BLOCK_IDS, BLOCK_DOCS = 1 << 15, 1 << 14
#: Pieces that a worker remembers, about 40 bytes each; and new ones between two merges into the sorted table.
CACHE, RECENT = 1_600_000, 60_000
#: Bytes of text taken at once: the arrays of a slice then stay in the processor's cache.
SLICE = 1 << 18
_SAMPLE = 512


class EliasFano:
    """A non-decreasing sequence of integers from 0."""

    def __init__(self, n: int, l: int, low: bytes, high: bytes) -> None:
        self.n, self.l, self._low, self._high = n, l, low, np.frombuffer(high, np.uint8)
        # for each 512th one the byte that holds it, and how many ones stand before it in that byte
        count = -(-n // _SAMPLE)
        self._byte, self._rest = np.zeros(count, np.uint32), np.zeros(count, np.uint8)
        seen = done = 0
        for at in range(0, len(self._high), 1 << 16):
            upto = np.cumsum(np.bitwise_count(self._high[at : at + (1 << 16)]), dtype=np.uint32)
            stop = min(count, -(-(seen + int(upto[-1])) // _SAMPLE))
            want = np.arange(done, stop) * _SAMPLE - seen
            k = np.searchsorted(upto, want, "right")
            self._byte[done:stop] = at + k
            self._rest[done:stop] = want - np.where(k > 0, upto[k - 1], 0)
            seen, done = seen + int(upto[-1]), max(done, stop)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        u = int(v[-1]) + 1 if n else 1
        l = max(0, (u // max(n, 1)).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        high = np.zeros(n + (u >> l) + 1, np.uint8)
        high[(v >> np.uint64(l)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, l, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQ", self.n, self.l, len(self._low)) + self._low + self._high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, l, k = struct.unpack_from("<QBQ", raw)
        return cls(n, l, raw[17 : 17 + k], raw[17 + k :])

    def select(self, i: int) -> int:
        """The i-th value: from the directory's byte on, popcounts up to the byte of the i-th one."""
        k = i // _SAMPLE
        byte = int(self._byte[k])
        left = i - k * _SAMPLE + int(self._rest[k])
        end = int(self._byte[k + 1]) + 1 if k + 1 < len(self._byte) else len(self._high)
        upto = np.cumsum(np.bitwise_count(self._high[byte:end]), dtype=np.uint32)
        skip = int(np.searchsorted(upto, left, "right"))
        left -= int(upto[skip - 1]) if skip else 0
        byte += skip
        x = int(self._high[byte])
        for _ in range(left):
            x &= x - 1
        at = byte * 8 + (x & -x).bit_length() - 1
        low = 0
        if self.l:
            first = i * self.l
            word = int.from_bytes(self._low[first // 8 : (first + self.l + 7) // 8 + 1], "little")
            low = (word >> (first % 8)) & ((1 << self.l) - 1)
        return ((at - i) << self.l) | low

    def all(self) -> np.ndarray:
        """Every value, in one pass."""
        ones = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.l)
        if self.l and self.n:
            bits = np.unpackbits(np.frombuffer(self._low, np.uint8), bitorder="little")[: self.n * self.l].reshape(self.n, self.l)
            out |= (bits.astype(np.uint64) << np.arange(self.l, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out.astype(np.int64)


#: White space other than space and newline, in UTF-8.
_OTHER_SPACE = re.compile(rb"[\t\r\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_BYTES = np.random.default_rng(20240301).integers(1, 1 << 63, 256, dtype=np.uint64)


class PieceEncoder:
    """A tokenizers file as texts -> ids.

    The byte-level pre-tokenizer cuts before a single space and around a single newline between non-spaces, whatever stands there. So a
    text is tiled with pieces, each a space or newline and what follows up to the next; texts with other or repeated white
    space, or some at the end, or with the content of an added token go to the library whole. Pieces are known by two 64-bit hashes, of their bytes in order and of their bytes as such; new ones go to the library
    together, a newline between them, and their ids are kept in a pool that all later texts are put together from."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        #: Added tokens are found wherever they stand, so texts with one go whole.
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        (self.newline,) = self.tok.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        #: Two tables of hash, second hash, place in the pool and number of ids, sorted by hash: a large one and a recent one.
        self.tables = [none, none]
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of each piece's ids in the pool. A newline in front of a piece is the one between pieces."""
        starts, sizes = [], []
        groups = [pieces[i : i + 200] for i in range(0, len(pieces), 200)]
        for i in range(0, len(groups), 50):
            some = groups[i : i + 50]
            texts = [(b"\n" + b"\n".join([x[1:] if x[:1] == b"\n" else x for x in g])).decode("utf-8") for g in some]
            for g, ids in zip(some, self.whole(texts), strict=True):
                at = np.flatnonzero(ids == self.newline)
                if len(at) != len(g):
                    raise ValueError("pieces and newlines differ")
                lead = np.array([x[:1] != b"\n" for x in g], np.int64)
                while self.used + len(ids) > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.dtype)])
                self.pool[self.used : self.used + len(ids)] = ids
                starts.append(at + lead + self.used)
                sizes.append(np.append(at[1:], len(ids)) - at - lead)
                self.used += len(ids)
        return np.concatenate(starts), np.concatenate(sizes).astype(np.int32)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b, strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a slice of UTF-8 bytes."""
        n = len(offsets) - 1
        space = (data == 0x20) | (data == 0x0A)
        raw = data.tobytes()
        # texts that go whole: white space next to white space, at the end, or of another kind
        inner = offsets[1:-1]
        pair = space[:-1] & space[1:] if len(data) else space
        odd = np.flatnonzero(pair) + 1
        odd = odd[~np.isin(odd, inner)]
        careful = np.zeros(n, bool)
        careful[np.searchsorted(offsets, odd, "right") - 1] = True
        full = np.flatnonzero(np.diff(offsets) > 0)
        careful[full[space[offsets[full + 1] - 1]]] = True
        for i in np.flatnonzero(_MAY_BE_SPACE[data]).tolist():
            if _OTHER_SPACE.match(raw, i):
                careful[np.searchsorted(offsets, i, "right") - 1] = True
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, "right")) - 1
                careful[i] = True
                at = raw.find(content, int(offsets[i + 1]) if at + len(content) <= offsets[i + 1] else at + 1)
        out: list[np.ndarray | None] = [None] * n
        late = np.flatnonzero(careful).tolist()
        for i, ids in zip(late, self.whole([raw[offsets[i] : offsets[i + 1]].decode("utf-8") for i in late]), strict=True):
            out[i] = ids
        # pieces of the others
        space[offsets[full]] = True
        begin = np.flatnonzero(space)
        doc = np.searchsorted(offsets, begin, "right") - 1
        end = np.append(begin[1:], len(data))
        keep = ~careful[doc]
        begin, end, doc = begin[keep], end[keep], doc[keep]
        if not len(begin):
            return [np.zeros(0, self.dtype) if x is None else x for x in out]
        h = textvec.word_hashes(data, begin, end)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data], out=total[1:])
        g = total[end] - total[begin]
        key, first, back = np.unique(h, return_index=True, return_inverse=True)
        if (g != g[first][back]).any():  # two pieces with one half of the hash
            return [np.array(self.tok.encode(raw[offsets[i] : offsets[i + 1]].decode("utf-8"), add_special_tokens=False).ids, self.dtype) for i in range(n)]
        if len(self.tables[0][0]) > CACHE:
            self.forget()
        start, size, hit = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        for known, check, place, number in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                here = (known[at] == key) & (check[at] == g[first])
                start[here], size[here] = place[at[here]], number[at[here]]
                hit |= here
        new = np.flatnonzero(~hit)
        if len(new):
            a, b = begin[first[new]].tolist(), end[first[new]].tolist()
            start[new], size[new] = self._learn([raw[i:j] for i, j in zip(a, b, strict=True)])
            rows = (key[new], g[first[new]], start[new].astype(np.int32), size[new].astype(np.int32))
            self.tables[1] = self._merged(self.tables[1], rows)
            if len(self.tables[1][0]) > RECENT:
                self.tables = [self._merged(*self.tables), tuple(x[:0] for x in rows)]
        where, length = start[back], size[back]
        edge = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=edge[1:])
        ids = self.pool[np.repeat(where - edge[:-1], length) + np.arange(edge[-1])]
        cut = edge[np.searchsorted(doc, np.arange(n + 1))]
        return [ids[cut[i] : cut[i + 1]] if x is None else x for i, x in enumerate(out)]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder. A function of this module, so that tasks share what it keeps."""
    return _encoders.get(path) or _encoders.setdefault(path, PieceEncoder(path))


_BLOCK = pa.schema([("part", pa.int32()), ("seq", pa.int32()), *((c, pa.int64()) for c in ("n_docs", "n_ids", "part_docs", "part_ids", "low_id", "n_null")), *((c, pa.binary()) for c in ("doc_ids", "bounds", "ids"))])
_BLOCK_DDL = "part int, seq int, n_docs long, n_ids long, part_docs long, part_ids long, low_id long, n_null long, doc_ids binary, bounds binary, ids binary"


def _writer(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        seq = docs_before = ids_before = 0
        ids: list[int | None] = []
        chunks: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, docs_before, ids_before, held
            n_null = sum(x is None for x in ids)
            known = np.array([x for x in ids if x is not None], np.int64)
            low = int(known[0]) if len(known) else 0
            ends = np.cumsum([len(c) // enc.dtype.itemsize for c in chunks])
            row = (part, seq, len(ids), int(ends[-1]), docs_before, ids_before, low, n_null, EliasFano.of(known - low).to_bytes(), EliasFano.of(ends).to_bytes(), b"".join(chunks))
            seq, docs_before, ids_before, held = seq + 1, docs_before + len(ids), ids_before + int(ends[-1]), 0
            ids.clear()
            chunks.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in batches:
            row_ids = batch.column(batch.schema.get_field_index("row_id")).to_pylist()
            for a, _, data, off in text_slices(batch, "text", SLICE):
                for i, x in enumerate(enc.encode(data, off)):
                    ids.append(row_ids[a + i])
                    chunks.append(x.tobytes() + end)
                    held += len(x) + 1
                    if held >= BLOCK_IDS or len(ids) >= BLOCK_DOCS:
                        yield close()
        if ids:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty), append end_id, and write blocks to path in ascending id order, null ids first."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange("row_id").sortWithinPartitions("row_id")
    dealt.mapInArrow(_writer(tokenizer, end_id), _BLOCK_DDL).write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)


_DOC = pa.schema([("row_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            bounds = EliasFano.from_bytes(r["bounds"])
            ids = np.frombuffer(r["ids"], "<u2" if len(r["ids"]) == 2 * r["n_ids"] else "<u4").astype("<u4")
            ends = np.array([bounds.select(i) for i in range(bounds.n)], np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            doc_ids = [None] * r["n_null"] + (EliasFano.from_bytes(r["doc_ids"]).all() + r["low_id"]).tolist()
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + r["part_ids"] + r["base"]), pa.array(ends - starts), pa.array(crc, pa.int64())], schema=_DOC)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """row_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the blocks at path.

    The offset of each part comes from one total per part (the number of range partitions bounds it), the offset of a block inside its part
    from the file, that of a document from the block's boundaries.
    """
    ship(spark)
    blocks = spark.read.schema(_BLOCK_DDL).parquet(path)
    totals = {r[0]: r[1] for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect()}
    bases, at = [], 0
    for p in sorted(totals):
        bases.append((p, at))
        at += totals[p]
    base = spark.createDataFrame(bases, "part int, base long")
    return blocks.select("part", "n_ids", "part_ids", "low_id", "n_null", "doc_ids", "bounds", "ids").join(F.broadcast(base), "part").mapInArrow(_read, "row_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).withColumnRenamed("row_id", "doc_id")


ORACLES: dict[str, str] = {}
