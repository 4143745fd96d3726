"""Text expressions: sentences, passages, windows and features as Columns. Only nested JSON values are walked in Python, over Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.functions.scalars import _c

# A sentence ends at a full stop, exclamation or question mark, closing quotes and brackets after it, white
# space, and an upper-case letter, digit, quote or opening bracket to come.
_SPACE = r"[\s\x1c-\x1f]"
_PIECE = r"(?sU).+?(?:(?<=[.!?])[\"'”’\])]*" + _SPACE + r"+(?=[A-Z0-9\"'“‘\[(])|\z)"
_EDGES = rf"(?U)^{_SPACE}+|{_SPACE}+$"
#: The characters that _SPACE stands for.
_WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# Fixed value: the mark before a passage, with its number.
_MARK = r"(?i)(?:^|\n\s*)passage\s+(\d+)\s*:\s*"
# Patterns of the surface features, in English and Portuguese.
WORD = r"(?U)\b\w+(?:['’-]\w+)*\b"
ENUMERATION = r"(?U)(?:^|\n|\s)(?:\*|[-•]|\(?\d+[.)]|[A-Za-z][.)])\s"
QUOTES = r"[\"“”‘’]"
NEGATION = r"(?iU)\b(?:not|no|never|without|cannot|can't|didn't|isn't|aren't|won't|não|nunca|sem|nem)\b"
TERMINAL = r"[.!?؟。！？]$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise(x: Column | str) -> Column:
    """White space runs to one space, ends trimmed, null to empty."""
    return F.btrim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)\s+", " "))


def blank(x: Column | str) -> Column:
    return ~F.coalesce(_c(x), F.lit("")).rlike(r"(?U)\S")


def tokens(x: Column | str) -> Column:
    """White-space tokens of the normalised text, none for a blank one."""
    t = normalise(x)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def word_count(x: Column | str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(r"(?U)\w+"), F.lit(0)))


def has_words(x: Column | str, least: int) -> Column:
    """Whether word_count is least or more; what follows the last of these words isn't read."""
    some = rf"(?U)\A\W*+\w++(?:\W++\w++){{{least - 1}}}"
    return F.coalesce(_c(x), F.lit("")).rlike(some) if least > 0 else F.lit(True)


def sha_key(*parts: Column | str) -> Column:
    """sha256 of the parts with a unit separator between."""
    return F.sha2(F.concat_ws(chr(31), *[_c(p).cast("string") for p in parts]), 256)


def pair_id(a: Column | str, b: Column | str) -> Column:
    """sha256 of the two normalised texts as a compact JSON array."""
    return F.sha2(F.to_json(F.array(normalise(a), normalise(b))), 256)


def surface(x: Column | str) -> dict[str, Column]:
    """Surface features of a text by name."""
    t = F.coalesce(_c(x), F.lit(""))
    n = sentence_count(t)
    return {
        "n_words": F.size(F.regexp_extract_all(t, F.lit(WORD), F.lit(0))),
        "n_chars": F.length(t),
        "n_sentences": n,
        "multi_sentence": n > 1,
        "enumeration": t.rlike(ENUMERATION),
        "has_digit": t.rlike(r"(?U)\d"),
        "has_quote": t.rlike(QUOTES),
        "has_negation": t.rlike(NEGATION),
        "ends_sentence": F.substring(F.btrim(t, F.lit(_WHITE)), -1, 1).rlike(TERMINAL),
    }


def length_metrics(a: Column | str, b: Column | str, low: float = 0.40, high: float = 2.50) -> dict[str, Column]:
    """Length ratio of a text b to its source a, both as they are, and flags; emptiness, identity and words are those of the normalised texts."""
    x, y = F.coalesce(_c(a), F.lit("")), F.coalesce(_c(b), F.lit(""))
    ratio = F.try_divide(F.length(y).cast("double"), F.length(x).cast("double"))
    return {
        "source_chars": F.length(x),
        "target_chars": F.length(y),
        "source_words": F.size(tokens(x)),
        "target_words": F.size(tokens(y)),
        "ratio": ratio,
        "target_empty": (normalise(x) != "") & (normalise(y) == ""),
        "identical": normalise(x) == normalise(y),
        "low_ratio": F.coalesce(ratio < low, F.lit(False)),
        "high_ratio": F.coalesce(ratio > high, F.lit(False)),
    }


def longest_run(x: Column | str, unit: int) -> Column:
    """The longest run of equal adjacent units of so many tokens, over all phases; case is folded. 0 without tokens, else 1 at least.

    Token i starts a repeat if it equals token i + unit; r such tokens in a row make r // unit + 1 equal units."""
    t = tokens(F.lower(F.coalesce(_c(x), F.lit(""))))
    n = F.size(t)
    rest = F.greatest(n - unit, F.lit(0))
    # one pass each: the array of "equals the one a unit further", then the longest row of true in it
    again = F.zip_with(F.slice(t, F.lit(1), rest), F.slice(t, F.lit(1 + unit), rest), lambda a, b: a == b)
    state = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, same: Column) -> Column:
        run = F.when(same, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    best = F.aggregate(again, state, step)["best"]
    return F.when(n == 0, 0).otherwise(F.floor(best / unit).cast("int") + 1)


def odd_controls(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit("")).rlike(r"[\x00-\x08\x0B-\x1F\x7F-\x9F]")


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, _EDGES, "")


def passages(x: Column | str) -> Column:
    """Texts behind `passage N:` marks, ends trimmed; without marks, paragraphs."""
    t = F.coalesce(_c(x), F.lit(""))
    parts = F.when(t.rlike(_MARK), F.slice(F.split(t, _MARK), 2, 1_000_000)).otherwise(F.split(t, r"(?U)\n\s*\n"))
    return F.filter(F.transform(parts, _trimmed), lambda p: p != "")


def indexed_passages(x: Column | str) -> Column:
    """(index, text) of passages, normalised: the index is the mark's number less 1; without marks, the place among non-blank parts
    between empty lines."""
    t = F.coalesce(_c(x), F.lit(""))
    marked = F.zip_with(F.regexp_extract_all(t, F.lit(_MARK), F.lit(1)), F.slice(F.split(t, _MARK), 2, 1_000_000), lambda n, p: F.struct((n.cast("int") - 1).alias("index"), normalise(p).alias("text")))
    plain = F.transform(F.filter(F.transform(F.split(t, r"\n\n"), normalise), lambda p: p != ""), lambda p, i: F.struct(i.alias("index"), p.alias("text")))
    return F.when(t.rlike(_MARK), F.filter(marked, lambda p: p["text"] != "")).otherwise(plain)


#: Values of a block of a running sum.
_BLOCK = 32


def _starts(n: Column, levels: int = 2) -> Column:
    """Sums of all earlier values of an array that isn't empty: each block sums its own, the blocks' totals are summed in the same way, so that the
    work is in proportion to the array."""
    grow = lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))
    if not levels:
        return F.aggregate(n, F.array(F.lit(0)), grow)

    def carried(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.element_at(b, -1))
        before = let(totals, lambda v: _starts(v, levels - 1))
        return let(before, lambda k: F.flatten(F.transform(blocks, lambda b, i: let(F.get(k, i), lambda c: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda v: v + c)))))

    own = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int")), lambda k: F.aggregate(F.slice(n, k * _BLOCK + 1, F.lit(_BLOCK)), F.array(F.lit(0)), grow))
    return let(own, carried)


_SENTENCES = "array<struct<start:int,end:int,text:string>>"


def _bodies(p: Column) -> Column:
    """(start, end, text) of the pieces of a text, in its characters, without white space around them."""

    def one(piece: Column, a: Column) -> Column:
        lead = F.length(piece) - F.length(F.ltrim(piece, F.lit(_WHITE)))
        body = F.btrim(piece, F.lit(_WHITE))
        return F.struct((a + lead).alias("start"), (a + lead + F.length(body)).alias("end"), body.alias("text"))

    return let(F.transform(p, F.length), lambda n: let(_starts(n), lambda s: F.filter(F.zip_with(p, F.slice(s, F.lit(1), F.size(p)), one), lambda r: r["end"] > r["start"])))


def sentence_texts(x: Column | str) -> Column:
    """(start, end, text) of sentences: half-open character ranges, trimmed; the whole text if there is no end inside; none for a blank one."""
    t = F.coalesce(_c(x), F.lit(""))
    return F.when(blank(t), F.array().cast(_SENTENCES)).otherwise(let(F.regexp_extract_all(t, F.lit(_PIECE), F.lit(0)), _bodies))


def sentence_count(x: Column | str) -> Column:
    """How many sentence_texts has. A piece ends behind a mark and the next one begins with a letter or the like, so only a blank text has a blank piece."""
    t = F.coalesce(_c(x), F.lit(""))
    return F.when(F.btrim(t, F.lit(_WHITE)) == "", 0).otherwise(F.size(F.regexp_extract_all(t, F.lit(_PIECE), F.lit(0))))


def _runs(ranges: Column, spans: Column) -> Column:
    """(i, n): place and length of the runs of ranges in which a span (start, end) touches each two neighbours."""
    meet = lambda a, b: F.coalesce(F.exists(spans, lambda s: (s["start"] < a["end"]) & (s["end"] > b["start"]) & (s["start"] < s["end"])), F.lit(False))
    places = F.when(F.size(ranges) > 0, F.sequence(F.lit(0), F.size(ranges) - 1)).otherwise(F.array().cast("array<int>"))
    first = F.filter(places, lambda i: (i == 0) | ~meet(F.get(ranges, i - 1), F.get(ranges, i)))
    return let(first, lambda f: F.transform(f, lambda i, k: F.struct(i.alias("i"), (F.coalesce(F.get(f, k + 1), F.size(ranges)) - i).alias("n"))))


def joined_ranges(ranges: Column, spans: Column) -> Column:
    """Ranges of which a span (start, end) touches several become one: neighbours always, so each is compared with the one before it."""
    joined = lambda r: F.transform(_runs(r, spans), lambda x: F.struct(F.get(r, x["i"])["start"].alias("start"), F.get(r, x["i"] + x["n"] - 1)["end"].alias("end")))
    return let(ranges, joined)


def joined_sentences(x: Column | str, spans: Column) -> Column:
    """sentence_texts with joined_ranges; the text of several is that of their pieces, which lie end to end."""
    t = F.coalesce(_c(x), F.lit(""))

    def claims(p: Column, s: Column) -> Column:
        def one(r: Column) -> Column:
            whole = F.btrim(F.array_join(F.slice(p, r["i"] + 1, r["n"]), ""), F.lit(_WHITE))
            return F.when(r["n"] == 1, F.get(s, r["i"])).otherwise(F.struct(F.get(s, r["i"])["start"].alias("start"), F.get(s, r["i"] + r["n"] - 1)["end"].alias("end"), whole.alias("text")))

        return F.transform(_runs(s, spans), one)

    return F.when(blank(t), F.array().cast(_SENTENCES)).otherwise(let(F.regexp_extract_all(t, F.lit(_PIECE), F.lit(0)), lambda p: let(_bodies(p), lambda s: claims(p, s))))


def sentences(x: Column | str) -> Column:
    """(start, end) of sentence_texts."""
    return F.transform(sentence_texts(x), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))


def sentence_windows(x: Column | str, size: int = 3, stride: int = 2) -> Column:
    """Texts of size sentences each, a stride apart, joined by spaces; the last is the first that reaches the end."""
    t = F.coalesce(_c(x), F.lit(""))

    def windows(s: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(s) - size) / stride)).cast("int")
        return F.when(F.size(s) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(s, i * stride + 1, F.lit(size)), " ")))

    return let(F.transform(sentence_texts(t), lambda r: r["text"]), windows)


def flatten_value(root: object) -> list[str]:
    """`path: value` lines of a nested value in reading order, keys joined by dots, places in lists in brackets; null is written so, blanks stay. The
    values still to be read lie on a stack, so nesting of any depth is read."""
    lines: list[str] = []
    waiting: list[tuple[str, object]] = [("", root)]
    while waiting:
        path, node = waiting.pop()
        match node:
            case dict():
                waiting += [(f"{path}.{key}" if path else key, node[key]) for key in reversed(node)]
            case list():
                waiting += [(f"{path}[{n}]", node[n]) for n in range(len(node) - 1, -1, -1)]
            case _:
                lines.append((path and f"{path}: ") + ("null" if node is None else f"{node}"))
    return lines


@F.pandas_udf(T.ArrayType(T.StringType()))
def flatten_json(values: pd.Series) -> pd.Series:
    """flatten_value of JSON texts; null has no lines, a text that is no JSON is an error."""
    return values.map(lambda x: [] if x is None else flatten_value(json.loads(x)))


def evidence_units(task: Column | str, source: Column | str) -> Column:
    """What evidence is taken from, by task: the passages of QA, windows of three sentences of Summary, lines of the JSON of Data2txt. Any other
    task is an error."""
    task, source = _c(task), _c(source)
    lines = flatten_json(F.when(task == "Data2txt", source))
    wrong = F.raise_error(F.concat(F.lit("unknown task: "), F.coalesce(task, F.lit("null")))).cast("array<string>")
    return F.when(task == "QA", passages(source)).when(task == "Summary", sentence_windows(source)).when(task == "Data2txt", lines).otherwise(wrong)
