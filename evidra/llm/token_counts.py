"""Token counts that follow edits: a segment tree of pre-tokens for each document.

Byte-pair encoding works inside pre-tokens, so a document's count is a sum over them. Leaves hold runs of about LEAF
pre-tokens as text; inner nodes hold the characters and tokens below. An edit replaces a character range: the leaves that it touches,
with two characters of context before (what a pre-token's end was decided on), are cut into pre-tokens again, one leaf more at a time until
a cut falls on the next leaf's start; from there the old cuts hold. Only these leaves are counted again, and the sums on their paths.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import ship, text_slices

LEAF = 64
#: Entries of a worker's cache of pre-token counts.
CACHE = 400_000
Edit = tuple[int, int, str]


class Counter:
    """Pre-tokens and their token counts, by a ranks file and its pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self._encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, int] = {}

    def counts(self, pre: list[str]) -> list[int]:
        if len(self._known) > CACHE:
            self._known.clear()
        got = list(map(self._known.get, pre))
        if None in got:
            for i, n in enumerate(got):
                if n is None:
                    got[i] = self._known[pre[i]] = len(self._encode(pre[i]))
        return got

    def whole(self, text: str) -> int:
        return sum(self.counts(self.split(text)))


class TokenTree:
    """A document's text with its token count under edits."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter = counter
        self._build(counter.split(text))

    def _build(self, pre: list[str]) -> None:
        n = self.counter.counts(pre)
        self.leaves = ["".join(pre[i : i + LEAF]) for i in range(0, len(pre), LEAF)] or [""]
        size = 1
        while size < len(self.leaves):
            size *= 2
        self.size = size
        pad = [0] * (size - len(self.leaves))
        self.tokens = [0] * size + [sum(n[i : i + LEAF]) for i in range(0, max(len(pre), 1), LEAF)] + pad
        self.chars = [0] * size + [len(x) for x in self.leaves] + pad
        for i in range(size - 1, 0, -1):
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at, and the leaf's first character."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def _set(self, first: int, texts: list[str], tokens: list[int]) -> None:
        touched = set()
        for k, (x, n) in enumerate(zip(texts, tokens, strict=True), first):
            self.leaves[k] = x
            self.tokens[self.size + k], self.chars[self.size + k] = n, len(x)
            touched.add((self.size + k) // 2)
        while touched:
            for i in touched:
                if i:
                    self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
                    self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            touched = {i // 2 for i in touched if i > 1}

    def edit(self, start: int, end: int, new: str) -> int:
        """Put new in place of characters start to end; the pre-tokens that were encoded again."""
        total = self.chars[1]
        start, end = max(0, min(start, total)), max(0, min(end, total))
        end = max(start, end)
        a, before = self._find(max(start - 2, 0))
        b = max(a, self._find(min(end + 1, max(total - 1, 0)))[0])
        while True:
            region = "".join(self.leaves[a : b + 1])
            region = region[: start - before] + new + region[end - before :]
            # the next leaf with text is the context behind
            k = b + 1
            while k < len(self.leaves) and not self.leaves[k]:
                k += 1
            if k >= len(self.leaves):
                pre = self.counter.split(region)
                break
            pre, at = [], 0
            for p in self.counter.split(region + self.leaves[k]):
                if at >= len(region):
                    break
                pre.append(p)
                at += len(p)
            if at == len(region):
                break
            b = k
        n = self.counter.counts(pre)
        room = b - a + 1
        per = max(1, -(-len(pre) // room))
        if per > 8 * LEAF:
            self._build(self.counter.split("".join(self.leaves[:a]) + region + "".join(self.leaves[b + 1 :])))
            return len(pre)
        cut = [(i * per, (i + 1) * per) for i in range(room)]
        self._set(a, ["".join(pre[i:j]) for i, j in cut], [sum(n[i:j]) for i, j in cut])
        return len(pre)


def apply_edits(tree: TokenTree, edits: list[Edit]) -> tuple[int, int]:
    """Edits in the coordinates of the text as it is, from the last to the first; of two that overlap the later is left
    out. The number applied and the pre-tokens encoded again."""
    kept: list[Edit] = []
    for e in sorted(edits):
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    return len(kept), sum(tree.edit(*e) for e in reversed(kept))


_MAIL = re.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]{5,}")


def masking_edits(text: str) -> list[Edit]:
    """Mail addresses and long runs of digits become fixed marks."""
    out = [(*m.span(), "0") for m in _DIGITS.finditer(text)]
    if "@" in text:
        out += [(*m.span(), "<mail>") for m in _MAIL.finditer(text)]
    return out


_counters: dict[tuple[str, str], Counter] = {}


def counter_of(path: str, pattern: str) -> Counter:
    """The worker's counter. A function of this module, so that tasks share what it keeps."""
    return _counters.get((path, pattern)) or _counters.setdefault((path, pattern), Counter(path, pattern))


_OUT = pa.schema([("row_id", pa.int64()), *((c, pa.int64()) for c in ("n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "n_recounted"))])


def _run(path: str, pattern: str, find: Callable[[str], list[Edit]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, pattern)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("row_id"))
            given = None if find else batch.column(batch.schema.get_field_index("edits")).to_pylist()
            for a, b, data, off in text_slices(batch, "text", 1 << 20):
                raw, off = data.tobytes(), off.tolist()
                cols: list[list] = [[] for _ in range(5)]
                for i in range(b - a):
                    text = raw[off[i] : off[i + 1]].decode("utf-8")
                    tree = TokenTree(text, counter)
                    n = tree.count
                    edits = find(text) if find else [(e["start"], e["end"], e["text"] or "") for e in given[a + i] or []]
                    done, again = apply_edits(tree, edits)
                    for c, v in zip(cols, (n, done, tree.count, tree.chars[1], again), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([rows.slice(a, b - a), *(pa.array(c, pa.int64()) for c in cols)], schema=_OUT)

    return run


def count_edited(docs: DataFrame, path: str, pattern: str, find: Callable[[str], list[Edit]] | None = masking_edits, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """row_id, n_tokens, n_edits, n_tokens_edited, n_chars_edited, n_recounted of every whole text.

    Edits come from find(text) or, without it, from the column edits_col: array of struct (start, end, text) in code
    points. Null text counts as empty: no tokens, edits only at its end. Ids may repeat or be null.
    """
    ship(docs.sparkSession)
    cols = [F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")]
    rows = docs.select(*cols, *([] if find else [F.col(edits_col).alias("edits")]))
    return rows.mapInArrow(_run(path, pattern, find), "row_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, n_recounted long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("row_id", "doc_id")


ORACLES: dict[str, str] = {}
