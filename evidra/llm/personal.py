"""Personal data: patterns find mail addresses, IP and card numbers and phones; a skip-chain conditional random field finds what repeats them.

Base spans come from four patterns alone and always stay. The field then looks at a document's active tokens, the runs between white space that hold a
digit or an @ or repeat the name part of one of the document's addresses. Every other token is outside of any entity by definition, so the chain falls apart into
runs of neighbouring active tokens and nothing has to be computed between them. A token's label is O, or the begin or inside of one of the four kinds. Tokens that
base spans cover are observed. Besides the chain, a token is joined to the next token with the same key (equal digits or address, the same last seven or last four digits,
the same name part) and to the first observed one with that key, however far away; joined tokens share a potential that favours equal kinds. Loopy belief
propagation carries the evidence through the whole document: a phone number without its plus sign is a phone where the full number stands elsewhere in
the text, and an unknown number where it does not.

Weights are learned from about SAMPLE documents, by gradients of marginals from the same propagation. Labels come from the base spans: a copy of each is put
back into its text in another spelling, as the same kind; numbers of the same spelling with other digits go in as O. Numbers of failed matches have no label.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import ship, text_slices

KINDS = ("email", "ip", "card", "phone")
#: Documents that are looked at for training; active tokens of one of them, and of all, at most; steps, rounds of messages, L2.
SAMPLE, DOC_TOKENS, TRAIN_TOKENS, STEPS, ROUNDS, L2 = 20_000, 400, 20_000, 200, 8, 1e-4

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME = "".join(map(chr, (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)))) + "._%+-"
#: A digit before the first part would belong to it, so the look-behind excludes nothing; it spares a second try inside a long number.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SEED = re.compile(r"[0-9@]+")
_REST = re.compile(r"[^\x20\x09-\x0D]*")
_EDGE = "\"'.,;:!?<>[]{}|#$&*=/\\`~^"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, whether it passes) of the leftmost non-overlapping matches of each pattern."""
    last = 0
    for m in _DOMAIN.finditer(text):
        name = text[last : m.start()]
        start = last + len(name.rstrip(_NAME))
        if start < m.start():
            yield 0, start, m.end(), True
            last = m.end()
        else:
            last = max(last, m.start())
    for m in _IP.finditer(text):
        yield 1, *m.span(), all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))
    for m in _CARD.finditer(text):
        d = _NOT_DIGIT.sub("", m[0])
        yield 2, *m.span(), 16 <= len(d) <= 19 and luhn(d)
    for m in _PHONE.finditer(text):
        yield 3, *m.span(), 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    return [(k, s, e) for k, s, e, ok in matches(text) if ok]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


# -- tokens, features, links ------------------------------------------------------------------------------------------

O, LABELS = 0, 9
_KIND_OF = np.array([-1, 0, 0, 1, 1, 2, 2, 3, 3])
_DIGIT_STEPS = (0, 1, 3, 4, 5, 7, 8, 10, 11, 12, 14, 16, 20)
_NAMES = [f"digits{a}" for a in _DIGIT_STEPS] + [f"run{a}" for a in _DIGIT_STEPS]
_NAMES += "bias plus paren at address ip quad luhn runluhn letters hex dot dash slash plain alone first name".split()
FEATURES = {n: i for i, n in enumerate(_NAMES)}
_QUAD = re.compile(r"[0-9]{1,3}(?:[^0-9A-Za-z][0-9]{1,3}){3}")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SPACES = " \t\n\v\f\r"


def _bucket(n: int) -> int:
    return int(np.searchsorted(_DIGIT_STEPS, n, "right")) - 1


def tokens(text: str, names: set[str]) -> list[tuple[int, int]]:
    """(start, end) of the active tokens without their outer marks, in order."""
    found, last = [], 0
    for m in _SEED.finditer(text):
        if m.start() < last:
            continue
        start = max(text.rfind(c, last, m.start()) for c in _SPACES) + 1
        start = max(start, last)
        last = _REST.match(text, m.end()).end()
        found.append((start, last))
    for n in names:
        for m in re.finditer(rf"(?<![^\s(\[]){re.escape(n)}(?![^\s)\],.;:!?])", text, re.IGNORECASE):
            found.append(m.span())
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(found)):
        if out and s < out[-1][1]:
            continue
        body = text[s:e]
        a = len(body) - len(body.lstrip(_EDGE))
        b = len(body.rstrip(_EDGE))
        core = body[a:b]
        while core and core[-1] in ")" and "(" not in core:
            core, b = core[:-1], b - 1
        while core and core[0] in "(" and ")" not in core:
            core, a = core[1:], a + 1
        if core:
            out.append((s + a, s + b))
    return out


def cover(at: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The label of each token that a span touches, the first span's where several do; -1 elsewhere."""
    out = np.full(len(at), -1)
    ends = np.array([e for _, e in at])
    for k, s, e in spans:
        first = i = int(np.searchsorted(ends, s, "right"))
        while i < len(at) and at[i][0] < e:
            if out[i] < 0:
                out[i] = 1 + 2 * k + (i > first)
            i += 1
    return out


class Graph:
    """Tokens of one text as nodes: features, what is observed, and edges (from, to, type); type 0 is the chain, 1 to 3 are links from strong to weak."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]) -> None:
        names = {text[s:e].split("@")[0].casefold() for k, s, e in spans if k == 0}
        names = {n for n in names if len(n) >= 5 and re.search(r"[0-9._%+-]", n)}
        self.at = tokens(text, names)
        n = len(self.at)
        self.observed = cover(self.at, spans)
        cores = [text[s:e] for s, e in self.at]
        digits = [_NOT_DIGIT.sub("", c) for c in cores]
        joined = np.array([b[0] - a[1] <= 3 and not text[a[1] : b[0]].strip(_SPACES + "()") for a, b in zip(self.at, self.at[1:], strict=False)], bool)
        head = np.flatnonzero(np.concatenate([[True], ~joined])[:n])
        edge = np.append(head, n)  # of the runs; without tokens there is none
        run = np.repeat(np.arange(len(head)), np.diff(edge))
        total = ["".join(digits[a:b]) if b - a <= 8 else "" for a, b in zip(edge[:-1], edge[1:], strict=True)]
        self.features = [self._features(c, d, total[r], i == head[r], c.casefold() in names) for i, (c, d, r) in enumerate(zip(cores, digits, run, strict=True))]
        chain = np.flatnonzero(joined)
        links: dict[tuple[int, int], int] = {}  # of a pair the strongest
        groups: dict[tuple, list[int]] = {}
        for i, (c, d) in enumerate(zip(cores, digits, strict=True)):
            low = c.casefold()
            if "@" in low or low in names:
                groups.setdefault((1, low.split("@")[0]), []).append(i)
            for kind, key in ((1, d), (2, d[-7:]), (3, d[-4:])):
                if len(d) >= (5, 7, 4)[kind - 1]:
                    groups.setdefault((kind, "#" + key), []).append(i)
            whole = total[run[i]]
            if len(d) < 7 <= len(whole) and i + 1 == edge[run[i] + 1]:  # a number in several tokens is known by its last one
                groups.setdefault((2, "#" + whole[-7:]), []).append(i)
        for (kind, _), members in sorted(groups.items()):
            seen = next((i for i in members if self.observed[i] > 0), None)
            for a, b in zip(members, members[1:], strict=False):
                links.setdefault((a, b), kind)
            if seen is not None:
                for i in members:
                    if i != seen and self.observed[i] < 0:
                        links.setdefault((min(i, seen), max(i, seen)), kind)
        self.edges = np.array([*((i, i + 1, 0) for i in chain), *((a, b, t) for (a, b), t in links.items())], np.int64).reshape(-1, 3)
        self.unary = np.zeros((n, LABELS))
        if n:
            self.unary[np.ix_(head, [2, 4, 6, 8])] = -30.0  # a run does not start inside of an entity

    @staticmethod
    def _features(core: str, digits: str, total: str, first: bool, name: bool) -> list[int]:
        f = [f"digits{_DIGIT_STEPS[_bucket(len(digits))]}", f"run{_DIGIT_STEPS[_bucket(len(total))]}", "bias"]
        letters = any(c.isalpha() for c in core)
        tests = {
            "plus": core[0] == "+",
            "paren": core[0] == "(",
            "at": "@" in core,
            "address": "@" in core and _ADDRESS.fullmatch(core) is not None,
            "ip": _QUAD.fullmatch(core) is not None and all(int(x) <= 255 for x in re.split("[^0-9]", core)),
            "quad": _QUAD.fullmatch(core) is not None,
            "luhn": 16 <= len(digits) <= 19 and luhn(digits),
            "runluhn": 16 <= len(total) <= 19 and luhn(total),
            "letters": letters,
            "hex": letters and len(digits) > 4,
            "dot": "." in core,
            "dash": "-" in core,
            "slash": "/" in core or ":" in core,
            "plain": len(digits) == len(core),
            "alone": total == digits,
            "first": first,
            "name": name,
        }
        return [FEATURES[x] for x in f + [k for k, v in tests.items() if v]]


class Field:
    """Weights: emissions (features x labels), chain transitions, and for each link type what two O and what two equal kinds gain."""

    def __init__(self) -> None:
        self.emit = np.zeros((len(FEATURES), LABELS))
        self.chain = np.zeros((LABELS, LABELS))
        self.link = np.array([[0.3, 1.5], [0.3, 1.0], [0.1, 0.3]])
        self.barred = np.zeros((LABELS, LABELS))
        for k in range(4):
            self.barred[[i for i in range(LABELS) if i not in (1 + 2 * k, 2 + 2 * k)], 2 + 2 * k] = -30.0

    def potentials(self) -> np.ndarray:
        out = np.zeros((4, LABELS, LABELS))
        out[0] = self.chain + self.barred
        same = (_KIND_OF[:, None] == _KIND_OF[None, :]) & (_KIND_OF[:, None] >= 0)
        for t in range(3):
            out[t + 1, O, O] = self.link[t, 0]
            out[t + 1][same] = self.link[t, 1]
        return out


def propagate(unary: np.ndarray, edges: np.ndarray, table: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log beliefs of nodes, and the messages along and against the edges. Exact where no link closes a loop and rounds span the chain."""
    i, j, t = edges.T
    ahead, back = np.zeros((len(edges), LABELS)), np.zeros((len(edges), LABELS))
    of_type = [(np.flatnonzero(t == k), np.exp(table[k])) for k in range(4)]
    belief = unary
    for r in range(rounds if len(edges) else 0):
        keep = 0.0 if r == 0 else 0.2
        new = []
        for at, against, turned in ((i, back, False), (j, ahead, True)):
            x = belief[at] - against
            x = np.exp(x - x.max(axis=1, keepdims=True))
            sent = np.empty_like(x)
            for rows, weight in of_type:
                sent[rows] = x[rows] @ (weight.T if turned else weight)
            sent = np.log(np.maximum(sent, 1e-300))
            new.append(sent - sent.max(axis=1, keepdims=True))
        ahead, back = keep * ahead + (1 - keep) * new[0], keep * back + (1 - keep) * new[1]
        belief = unary.copy()
        np.add.at(belief, j, ahead)
        np.add.at(belief, i, back)
    return belief, ahead, back


def _soft(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    x = np.exp(x - x.max(axis=axes, keepdims=True))
    return x / x.sum(axis=axes, keepdims=True)


def _fixed(unary: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """unary with all but the given label ruled out, where one is given (0 or more)."""
    out = unary.copy()
    known = np.flatnonzero(labels >= 0)
    out[known] -= 60.0
    out[known, labels[known]] += 60.0
    return out


def train(examples: list[tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]], steps: int = STEPS) -> Field | None:
    """A field from (features, edges, observed, labels, unary) of each text; label -1 is unknown. None without examples or without any kind among them."""
    if not any((lab > 0).any() for _, _, _, lab, _ in examples):
        return None
    base = np.cumsum([0] + [len(f) for f, *_ in examples])
    edges = np.concatenate([e + np.array([b, b, 0]) for (_, e, *_), b in zip(examples, base, strict=False)])
    seen, label, unary = (np.concatenate([x[k] for x in examples]) for k in (2, 3, 4))
    node = np.concatenate([np.repeat(np.arange(len(f)) + b, [len(x) for x in f]) for (f, *_), b in zip(examples, base, strict=False)]).astype(int)
    feature = np.concatenate([np.array([y for x in f for y in x], int) for f, *_ in examples])
    model = Field()
    free_nodes = (seen < 0) & (label >= 0)
    same = (_KIND_OF[:, None] == _KIND_OF[None, :]) & (_KIND_OF[:, None] >= 0)
    moment = [np.zeros_like(x) for x in (model.emit, model.chain, model.link)]
    scale = max(int(free_nodes.sum()), 1)
    for _ in range(steps):
        score = unary.copy()
        np.add.at(score, node, model.emit[feature])
        table = model.potentials()
        grads = [np.zeros_like(x) for x in (model.emit, model.chain, model.link)]
        for sign, fixed in ((1.0, np.where(seen >= 0, seen, label)), (-1.0, seen)):
            u = _fixed(score, fixed)
            belief, ahead, back = propagate(u, edges, table, 5)
            p = _soft(belief, (1,))
            np.add.at(grads[0], feature, sign * (p * (seen < 0)[:, None])[node])
            if len(edges):
                pair = _soft((belief[edges[:, 0]] - back)[:, :, None] + table[edges[:, 2]] + (belief[edges[:, 1]] - ahead)[:, None, :], (1, 2))
                grads[1] += sign * pair[edges[:, 2] == 0].sum(axis=0)
                for t in range(3):
                    mine = pair[edges[:, 2] == t + 1]
                    grads[2][t] += sign * np.array([mine[:, O, O].sum(), mine[:, same].sum()])
        for x, g, h in zip((model.emit, model.chain, model.link), grads, moment, strict=True):
            g = g / scale - L2 * x
            h += g * g
            x += g / np.sqrt(h + 1e-12)
    return model


def _accept(kind: int, text: str) -> bool:
    """The least that a span of a kind must have."""
    d = len(_NOT_DIGIT.sub("", text))
    return (d > 0 or "@" in text or any(c in "._%+-" for c in text), 4 <= d <= 12, 12 <= d <= 19, 7 <= d <= 15)[kind]


def consistent_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], model: Field | None) -> list[list[tuple[int, int, int]]]:
    """The spans of each text: the base ones, and those that the field adds. An added span overlaps no base span."""
    out = [list(b) for b in bases]
    if model is None:
        return out
    table = model.potentials()
    for k, text in enumerate(texts):
        if not _DIGIT.search(text) and "@" not in text:
            continue
        g = Graph(text, bases[k])
        if not len(g.at) or (g.observed >= 0).all():
            continue
        node = np.repeat(np.arange(len(g.at)), [len(f) for f in g.features])
        score = g.unary.copy()
        np.add.at(score, node, model.emit[np.concatenate(g.features)])
        belief, _, _ = propagate(_fixed(score, g.observed), g.edges, table)
        label = belief.argmax(axis=1)
        chained = {int(a) for a, _, t in g.edges if t == 0}
        i = 0
        while i < len(label):
            kind = int(_KIND_OF[label[i]])
            j = i + 1
            if kind >= 0 and g.observed[i] < 0:
                while j < len(label) and g.observed[j] < 0 and label[j] == 2 + 2 * kind and j - 1 in chained:
                    j += 1
                s, e = g.at[i][0], g.at[j - 1][1]
                if _accept(kind, text[s:e]) and not any(s < b and a < e for _, a, b in bases[k]):
                    out[k].append((kind, s, e))
            i = j
    return [sorted(s) for s in out]


# -- training texts ---------------------------------------------------------------------------------------------------


def _spelled(kind: int, text: str, how: int) -> str:
    """Another spelling that no base pattern takes."""
    d = _NOT_DIGIT.sub("", text)
    if kind == 0:
        return text.split("@")[0]
    if kind == 1:
        return re.sub(r"\.", ("-", ",", "_")[how % 3], text)
    if kind == 2:
        parts = [d[i : i + 4] for i in range(0, len(d), 4)]
        return (".".join(parts), "  ".join(parts), f"{d} {d}", "/".join(parts))[how % 4]
    d = d[-10:]
    return (f"{d[:-7]}-{d[-7:-4]}-{d[-4:]}", f"({d[:-7]}) {d[-7:-4]}-{d[-4:]}", d, f"{d[:-7]}.{d[-7:-4]}.{d[-4:]}")[how % 4]


def examples_of(text: str, limit: int = DOC_TOKENS) -> Iterator[tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Training graphs of a text: as it is, and with respelled copies of its entities (their kind) and of numbers made up (O); in the last one half of
    the base numbers are not observed, so that their own look is learned too."""
    found = list(matches(text))
    spans = [(k, s, e) for k, s, e, ok in found if ok]
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    for variant in range(1 if not spans else 3):
        placed: list[tuple[int, str, bool]] = []
        for k, s, e in spans[:20] if variant else []:
            how = int(rng.integers(12))
            placed.append((k, _spelled(k, text[s:e], how), True))
            fake = "".join(str(rng.integers(10)) if c.isdigit() else c for c in text[s:e])
            if k:
                placed.append((k, _spelled(k, fake, how), False))
        new, labelled = text, []
        for k, word, real in placed:
            at = [0, len(new), new.find(" ", int(rng.integers(len(new) + 1)))][int(rng.integers(3))]
            at = len(new) if at < 0 else at
            if any(a < at < b for a, b, _ in labelled) or any(s < at < e for _, s, e in base_spans(new)):
                at = len(new)
            piece = f" so {word} so "
            labelled = [(a + len(piece) * (a >= at), b + len(piece) * (a >= at), x) for a, b, x in labelled] + [(at + 4, at + 4 + len(word), k if real else -1)]
            new = new[:at] + piece + new[at:]
        again = list(matches(new))
        known = [(k, s, e) for k, s, e, ok in again if ok]
        g = Graph(new, known if variant < 2 else [x for x in known if x[0] == 0 or rng.random() < 0.5])
        if not 0 < len(g.at) <= limit:
            continue
        label = np.maximum(cover(g.at, known), O)
        for k, s, e, ok in again:  # failed matches of card, phone and IP length say nothing
            if not ok and len(_NOT_DIGIT.sub("", new[s:e])) >= 12:
                label[[i for i, (a, b) in enumerate(g.at) if a < e and s < b and g.observed[i] < 0]] = -1
        for a, b, k in labelled:
            mine = [i for i, (x, y) in enumerate(g.at) if x >= a and y <= b and g.observed[i] < 0 and label[i] <= O]
            seen_text = _NOT_DIGIT.sub("", new[a:b])
            for n, i in enumerate(mine):
                whole = k == 2 and len(_NOT_DIGIT.sub("", new[slice(*g.at[i])])) * 2 == len(seen_text)
                label[i] = O if k < 0 else 1 + 2 * k + (n > 0 and not whole)
        yield g.features, g.edges, g.observed, label, g.unary


_EX = pa.schema([("row_id", pa.int64()), ("crc", pa.int64()), ("part", pa.binary())])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    for batch in batches:
        ids, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("row_id", "text"))
        rows = [(i, zlib.crc32(t.encode()), pickle.dumps(x)) for i, t in zip(ids, texts, strict=True) if t and _SEED.search(t) for x in examples_of(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _EX, strict=True)], schema=_EX)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most: int = TRAIN_TOKENS) -> Field | None:
    """The field learned from about sample documents by a hash of id and text, of these those with active tokens, up to most tokens in the order of
    that hash. None if they hold no entity: then nothing is added."""
    import pickle

    spark = docs.sparkSession
    ship(spark)
    n = docs.count()
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    draw = F.pmod(F.xxhash64("row_id", "text", F.lit(29)), F.lit(1 << 30))
    rows = rows.where(draw.cast("double") * float(max(n, 1)) < float(sample * (1 << 30))).where(F.col("text").rlike("[0-9@]"))
    got = rows.mapInArrow(_gather, "row_id long, crc long, part binary").orderBy("crc", "row_id", "part").select("part")
    kept, held = [], 0
    for r in got.toLocalIterator():
        x = pickle.loads(r["part"])
        kept.append(x)
        held += len(x[0])
        if held >= most:
            break
    return train(kept)


_OUT = pa.schema([("row_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("spans", pa.string())])


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("row_id"))
            for a, b, data, off in text_slices(batch, "text", 4 << 20):
                raw, off = data.tobytes(), off.tolist()
                texts = [raw[x:y].decode() for x, y in zip(off[:-1], off[1:], strict=True)]
                bases = [base_spans(t) for t in texts]
                spans = consistent_spans(texts, bases, model)
                counts = [[sum(k == n for k, _, _ in s) for s in bases] for n in range(4)]
                cols = [ids.slice(a, b - a), *(pa.array(c, pa.int64()) for c in counts), pa.array([written(s) for s in bases]), pa.array([written(s) for s in spans])]
                yield pa.RecordBatch.from_arrays(cols, schema=_OUT)

    return run


def find_personal(docs: DataFrame, model: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, n_email, n_ip, n_card, n_phone (base spans), base and spans: kind:start:end by kind as listed, then start, joined by commas.

    Every whole text is read. Null counts as empty: no spans. Ids may repeat or be null; rows are told apart by nothing and need not be.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "row_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"
    return rows.mapInArrow(_finder(spark.sparkContext.broadcast(model)), schema)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_personal(docs, fit(docs))
    return found.select(F.col("row_id").alias("doc_id"), *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


ORACLES: dict[str, str] = {}
