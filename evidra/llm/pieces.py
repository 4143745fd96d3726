"""SentencePiece encoding and decoding by a streaming Viterbi over one pass of characters.

The vocabulary file is a byte-pair model: pieces with scores, byte pieces for what no piece covers. Its segmentation has a
dynamic program: two neighbouring pieces are allowed when encoding their text alone gives these two again, and a sequence
is the encoding of its text exactly when all neighbours in it are allowed. So every prefix of the text has one best path, whose last piece is the
only one that ends there and is allowed after the best path of what comes before. The search keeps back-pointers for a
window of the longest piece's length and commits ids as soon as all paths that end in the window meet in one boundary.
No piece has a space mark after another character, so a space after a non-space is always such a boundary, and words between
them are looked up in a bounded cache of committed ids first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import compress, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import ship, text_slices

SPACE = "▁"
#: Entries of each of the two generations of a worker's word cache.
CACHE = 300_000
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces:
    """A vocabulary: encode and decode."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.names) if not special[i]}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.names) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids))
        #: Boundaries of a window, after which paths are looked at for where they meet.
        self.span = 4 * self.longest
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.names)]
        # a piece that never comes out of its own text cannot end a path
        self.sound = {p for p in self.ids if self.merged(list(p)) == [p]}
        self.auto = ahocorasick.Automaton()
        for p in self.sound:
            self.auto.add_word(p, (len(p), self.ids[p]))
        self.auto.make_automaton()
        self.chars = {p for p in self.sound if len(p) == 1}
        self.allowed: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Byte-pair merging as such, for the short texts of two pieces: best score first, leftmost on ties."""
        scores = self.scores
        while len(symbols) > 1:
            best = max(range(len(symbols) - 1), key=lambda i: (scores.get(symbols[i] + symbols[i + 1], -np.inf), -i))
            joined = symbols[best] + symbols[best + 1]
            if joined not in scores:
                break
            symbols[best : best + 2] = [joined]
        return symbols

    def neighbours(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a."""
        got = self.allowed.get(a << 32 | b)
        if got is None:
            if len(self.allowed) > 1_000_000:
                self.allowed.clear()
            x, y = self.names[a], self.names[b]
            got = self.allowed[a << 32 | b] = self.merged(list(x + y)) == [x, y]
        return got

    def committed(self, text: str) -> Iterator[list[int]]:
        """The ids of a text of known characters, in runs, each as soon as it is certain."""
        names, allowed, neighbours = self.names, self.allowed.get, self.neighbours
        span, n, base = self.span, len(text), 0
        # the last piece of the best path to each boundary of the window: -1 no piece before, -2 no path
        last = [-1] + [-2] * min(n, span)
        for end, (size, p) in self.auto.iter(text):
            at = end + 1 - base
            if at >= len(last):
                # walk all paths that end in the reach of a piece back to where they meet
                live = {j for j in range(max(0, at - self.longest), len(last)) if last[j] != -2}
                while len(live) > 1:
                    j = max(live)
                    live.discard(j)
                    live.add(j - len(names[last[j]]))
                meet = live.pop()
                if meet:
                    yield self._back(last, meet)
                    base += meet
                    at -= meet
                    last[: meet + 1] = [-1]
                last += [-2] * (min(n - base, max(span, at)) + 1 - len(last))
            if last[at] == -2 and at >= size:
                before = last[at - size]
                if before >= 0:
                    ok = allowed(before << 32 | p)
                    if ok or (ok is None and neighbours(before, p)):
                        last[at] = p
                elif before == -1:
                    last[at] = p
        yield self._back(last, n - base)

    def _back(self, last: list[int], at: int) -> list[int]:
        run = []
        while at:
            run.append(last[at])
            at -= len(self.names[last[at]])
        return run[::-1]

    def _stream(self, marked: str) -> bytes:
        """Ids of a marked text. A character without a piece merges with nothing: what stands between such is searched on its own."""
        if self.chars.issuperset(marked):
            runs = self.committed(marked)
        else:
            runs = (r for known, part in groupby(marked, self.chars.__contains__) for r in (self.committed("".join(part)) if known else map(self._unknown, part)))
        return b"".join(np.array(run, self.dtype).tobytes() for run in runs)

    def _unknown(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def encode(self, text: str) -> bytes:
        """Ids, little-endian, of a text. An empty text has none."""
        if not text:
            return b""
        if not self.by_word:
            return self._stream(SPACE + text.replace(" ", SPACE))
        if len(self.cache) > CACHE:
            self.cache, self.old = {}, self.cache
        if "  " in text or text[0] == " " or SPACE in text:
            words = _SEGMENT.findall(SPACE + text.replace(" ", SPACE))
        else:
            words = [SPACE + w for w in text.split(" ")]
        got = list(map(self.cache.get, words))
        for w in set(compress(words, [g is None for g in got])):
            self.cache[w] = self.old.get(w) or self._stream(w)
        return b"".join([self.cache[w] if g is None else g for w, g in zip(words, got, strict=True)])

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 bytes of a text from its ids: the mark in front goes, marks become spaces."""
        out = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, self.dtype).tolist()))
        return out[1:] if out[:1] == b" " else out


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    return _loaded.get(path) or _loaded.setdefault(path, Pieces(path))


_OUT = pa.schema([("row_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_bytes", pa.int64()), ("round_trip", pa.bool_())])


def _encoder(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("row_id"))
            for a, b, data, off in text_slices(batch, "text", 1 << 20):
                raw, off = data.tobytes(), off.tolist()
                cols: list[list] = [[] for _ in range(5)]
                for i in range(b - a):
                    text = raw[off[i] : off[i + 1]]
                    ids = model.encode(text.decode("utf-8"))
                    back = model.decode(ids)
                    wide = np.frombuffer(ids, model.dtype).astype("<u4").tobytes()
                    for c, v in zip(cols, (ids if keep_ids else None, len(ids) // model.dtype.itemsize, zlib.crc32(wide), len(back), back == text), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([rows.slice(a, b - a), *(pa.array(c, f.type) for c, f in zip(cols, list(_OUT)[1:], strict=True))], schema=_OUT)

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """row_id, ids (little-endian, 16 bits while the vocabulary allows), n_tokens, ids_crc32 (of the ids as 32-bit
    integers), n_bytes of the decoded text, round_trip (decoding gives the text back).

    Null counts as empty and has no ids. A text that holds the space mark itself decodes to a space there, so its
    round_trip is false. Ids may repeat or be null; further columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoder(path, keep_ids), "row_id long, ids binary, n_tokens long, ids_crc32 long, n_bytes long, round_trip boolean")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)
    return out.drop("ids").withColumnRenamed("row_id", "doc_id")


ORACLES: dict[str, str] = {}
