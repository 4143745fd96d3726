"""Main text of web pages by wrapper induction.

A page's tree of containers (div, section, article and the like) is its shape; what stands between containers is one flow of text.
Runs of siblings of one shape count as one node, so shapes stay small. Pages of a host with equal shapes are one layout.

1. Every page gives its layout and, for each node, a hash of its text, its length and how much of it is links. Distinct pages
   are counted by (host, layout, node, text), folded in each task before the shuffle: html is never shuffled for this.
2. For each host, all layouts are aligned with the one of most pages by simple tree matching, and counts of matched nodes are added.
   A node whose text is the same on nearly all pages is template; the others are slots. The content is the node that the descent from the root
   towards most varying text outside links ends at. Layouts in which that node has no match get a wrapper of their own.
3. Every page is aligned with its host's wrappers by tree matching; the text of what matches the content is read, without template nodes and
   without what HTML or its names mark as navigation, notice, advert, form or comment. A page that aligns with none, or has no
   host, is a host of one page.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from html import unescape
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import materialise, ship

#: Layouts of a host that one task takes together. All layouts count; those of a host of more are aligned in as many tasks as there are, round by round.
LAYOUTS = 256
#: Distinct pages from which a text can be template, the share of pages that must have it, and the share of links that makes a box a menu.
AGREE, CONSTANT, LINKS = 3, 0.8, 0.8
#: The descent goes on into a node with so much of the varying text, if no other has so much of that one's.
MOST, OTHER = 0.6, 0.25
#: Pairs of children up to which two nodes are aligned by a table held whole; beyond, by its rows, with the same score.
TABLE = 250_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul br".split())
#: An opening tag ends an open one of these, as far as no container of the second set stands between.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ENDS_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "dt", "dd", "li", "body", "html", "figcaption"}
_SCOPE = frozenset({"table", "td", "th", "button", "html", "body"})
#: Elements, and words of class, id or role, that are never main text.
_CHROME_TAGS = frozenset("aside button dialog footer form header head iframe input menu nav noscript script select style svg template textarea title".split())
_CHROME_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination paywall popup promo related replies search share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split())
_CONTAINERS = frozenset("#root html body div section article main nav header footer aside form center fieldset dialog details figure hgroup search".split())
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("kids", "names", "tag")

    def __init__(self, tag: str, names: str = "") -> None:
        self.tag, self.names, self.kids = tag, names, []

    @property
    def key(self) -> str:
        return f"{self.tag}.{self.names}"

    @property
    def chrome(self) -> bool:
        return self.tag in _CHROME_TAGS or (self.tag not in ("html", "body", "article", "main") and not _CHROME_WORDS.isdisjoint(_SPLIT.split(self.names)))


def parse(html: str) -> Node:
    """A lenient tree: unclosed elements end where HTML ends them; stray end tags are dropped; the rest of a broken tag is text."""
    root = Node("#root")
    stack = [root]
    open_tags: Counter[str] = Counter()
    at = 0
    raw = ""

    def cut(i: int) -> None:
        open_tags.subtract(x.tag for x in stack[i:])
        del stack[i:]

    def end(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Close the innermost open element of tags, unless one of stop stands inside it."""
        if any(open_tags[t] for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    cut(i)
                    return
                if stack[i].tag in stop:
                    return

    for m in _TOKEN.finditer(html):
        if raw:
            if not (m[1] and m[2] and m[2].lower() == raw):
                continue  # inside script and the like only the end tag counts
            raw = ""
            cut(len(stack) - 1)
            at = m.end()
            continue
        if m.start() > at:
            stack[-1].kids.append(unescape(html[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            end({tag}, frozenset())
            continue
        if tag in _ENDS_P:
            end({"p"}, _SCOPE)
        if tag in _ENDS:
            end(*_ENDS[tag])
        names = " ".join((a[1] or a[2] or a[3]).lower() for a in _ATTR.findall(m[3]) if a[0].lower() in ("class", "id", "role", "itemprop")) if "=" in m[3] else ""
        node = Node(tag, names)
        stack[-1].kids.append(node)
        if tag not in _VOID and not m[3].endswith("/"):
            stack.append(node)
            open_tags[tag] += 1
            if tag in _RAW:
                raw = tag
    if not raw and at < len(html):
        stack[-1].kids.append(unescape(html[at:]))
    return root


def blocks(node: Node, skip: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """Blocks of text below a node in page order, white space folded, without chrome and without the nodes in skip (by id())."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        x, leave = stack.pop()
        if isinstance(x, str):
            now.append(x)
            continue
        if leave:
            close()
            continue
        if x is not node and (x.chrome or id(x) in skip):
            if x.tag in _BLOCK:
                close()
            continue
        if x.tag in _BLOCK:
            close()
            stack.append((x, True))
        stack.extend((k, False) for k in reversed(x.kids))
    close()
    return out


def _linked(node: Node) -> int:
    """Characters of text inside links, chrome left out."""
    total = 0
    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        x, inside = stack.pop()
        if isinstance(x, str):
            total += len(x.strip()) * inside
        elif not x.chrome or x is node:
            stack.extend((k, inside or x.tag == "a") for k in x.kids)
    return total


FLOW = "#flow"


class Shape:
    """A node of a page's tree of containers and flows. dom: what it stands for; text, chars, links: of a page; of a wrapper: size."""

    __slots__ = ("chars", "dom", "key", "kids", "links", "size", "text")

    def __init__(self, key: str, kids: list[Shape] | None = None, dom: list[Node] | None = None) -> None:
        self.key, self.kids, self.dom = key, kids or [], dom or []
        self.text = self.chars = self.links = 0
        self.size = 1 + sum(k.size for k in self.kids)

    def nodes(self) -> Iterator[Shape]:
        """In page order."""
        stack = [self]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(reversed(x.kids))

    def plain(self) -> list:
        """[depth, key] of every node in page order."""
        out: list[list] = []
        stack = [(0, self)]
        while stack:
            depth, x = stack.pop()
            out.append([depth, x.key])
            stack.extend((depth + 1, k) for k in reversed(x.kids))
        return out


def of_plain(rows: list) -> Shape:
    made: list[tuple[int, Shape]] = []
    path: list[Shape] = []
    for depth, key in rows:
        x = Shape(key)
        del path[depth:]
        if path:
            path[-1].kids.append(x)
        path.append(x)
        made.append((depth, x))
    for _, x in reversed(made):
        x.size = 1 + sum(k.size for k in x.kids)
    return made[0][1]


def _hash(x: str) -> int:
    return int.from_bytes(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def shape(root: Node) -> Shape:
    """The containers of a page, children first, so that depth is no matter."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(k for k in x.kids if isinstance(k, Node) and k.tag in _CONTAINERS)
    made: dict[int, Shape] = {}
    mark: dict[int, int] = {}  # hash of a shape's keys
    for x in reversed(order):
        kids: list[Shape] = []
        flow = Node("#between")

        def close(kids: list[Shape] = kids) -> None:
            nonlocal flow
            text = "\n".join(blocks(flow)) if flow.kids else ""
            if text:
                f = Shape(FLOW, dom=[flow])
                f.text, f.chars, f.links = _hash(text), len(text), _linked(flow)
                mark[id(f)] = 0
                kids.append(f)
            flow = Node("#between")

        for k in x.kids:
            if isinstance(k, Node) and k.tag in _CONTAINERS:
                close()
                c = made[id(k)]
                if kids and kids[-1].key == c.key and mark[id(kids[-1])] == mark[id(c)]:
                    run = kids[-1]
                    run.dom += c.dom
                    run.text, run.chars, run.links = _hash(f"{run.text} {c.text}"), run.chars + c.chars, run.links + c.links
                else:
                    kids.append(c)
            elif isinstance(k, str) or k.tag not in ("script", "style", "head"):
                flow.kids.append(k)
        close()
        s = made[id(x)] = Shape(x.key, kids, [x])
        s.text, s.chars, s.links = _hash(" ".join(str(k.text) for k in kids)) if kids else 0, sum(k.chars for k in kids), sum(k.links for k in kids)
        if x.chrome:
            s.chars = s.links = 0
        mark[id(s)] = _hash(f"{s.key} {[mark[id(k)] for k in kids]}")
    # what is folded into a run is no longer walked through
    for s in made.values():
        if len(s.dom) > 1:
            s.kids = []
    for x in reversed(order):
        made[id(x)].size = 1 + sum(k.size for k in made[id(x)].kids)
    return made[id(root)]


#: Frames of tree_match: one for each level of both trees that branches.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))


def tree_match(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: the largest number of pairs of nodes with equal keys, order and ancestry kept; and the pairs."""
    if a.key != b.key:
        return 0, []
    m, n = len(a.kids), len(b.kids)
    if m == 1 and n == 1:  # chains need no table; they are followed without recursion
        pairs = [(a, b)]
        while len(a.kids) == len(b.kids) == 1:
            a, b = a.kids[0], b.kids[0]
            if a.key != b.key:
                return len(pairs), pairs
            pairs.append((a, b))
        pairs.pop()
        score, rest = tree_match(a, b)
        return len(pairs) + score, pairs + rest
    if m * n > TABLE:
        return _by_rows(a, b)
    score = [[0] * (n + 1) for _ in range(m + 1)]
    how = [[tree_match(x, y) for y in b.kids] for x in a.kids]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            score[i][j] = max(score[i - 1][j], score[i][j - 1], score[i - 1][j - 1] + how[i - 1][j - 1][0])
    pairs = [(a, b)]
    i, j = m, n
    while i and j:
        if score[i][j] == score[i - 1][j]:
            i -= 1
        elif score[i][j] == score[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += how[i][j][1]
    return score[m][n] + 1, pairs


def _numbers(kids: list[Shape], known: dict[tuple, int]) -> list[int]:
    """A number for each of kids, the same for trees of equal shape."""
    of: dict[int, int] = {}
    for x in kids:
        for y in reversed(list(x.nodes())):
            of[id(y)] = known.setdefault((y.key, *(of[id(k)] for k in y.kids)), len(known))
    return [of[id(x)] for x in kids]


def _by_rows(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """The same for many children. Equal ones at either end meet, since no others can be worth more. Of the rest, pairs of equal shape are scored once, and of the rows of the table one
    in so many is kept; those between are made again on the way back."""
    known: dict[tuple, int] = {}
    x, y = _numbers(a.kids, known), _numbers(b.kids, known)
    start, m, n = 0, len(x), len(y)
    while start < min(m, n) and x[start] == y[start]:
        start += 1
    while min(m, n) > start and x[m - 1] == y[n - 1]:
        m, n = m - 1, n - 1
    pairs = [(a, b)]
    for p, q in [*zip(a.kids[:start], b.kids[:start], strict=True), *zip(a.kids[m:], b.kids[n:], strict=True)]:
        pairs += zip(p.nodes(), q.nodes(), strict=True)
    total = len(pairs)
    m, n = m - start, n - start
    if not (m and n):
        return total, pairs
    left, right = a.kids[start : start + m], b.kids[start : start + n]
    shapes, at = np.unique(y[start : start + n], return_index=True)
    column = np.searchsorted(shapes, y[start : start + n])
    by_key: dict[str, list[tuple[int, Shape]]] = {}
    for k, j in enumerate(at.tolist()):
        by_key.setdefault(right[j].key, []).append((k, right[j]))
    worth: dict[int, np.ndarray] = {}

    def row(i: int, before: np.ndarray) -> np.ndarray:
        w = worth.get(x[start + i])
        if w is None:
            w = worth[x[start + i]] = np.zeros(len(shapes), np.int32)
            for k, other in by_key.get(left[i].key, []):
                w[k] = tree_match(left[i], other)[0]
        out = before.copy()
        np.maximum(before[1:], before[:-1] + w[column], out=out[1:])
        return np.maximum.accumulate(out)

    step = isqrt(m) + 1
    now = np.zeros(n + 1, np.int32)
    kept = []
    for i in range(m):
        if i % step == 0:
            kept.append(now)
        now = row(i, now)
    total += int(now[n])
    j = n
    for k in range(len(kept) - 1, -1, -1):
        rows = [kept[k]]
        for i in range(k * step, min(m, (k + 1) * step)):
            rows.append(row(i, rows[-1]))
        i = len(rows) - 1
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs += tree_match(left[k * step + i], right[j])[1]
    return total, pairs


def _is_chrome(key: str) -> bool:
    tag, _, names = key.partition(".")
    return Node(tag, names).chrome


class Layout:
    """A layout of a host: its shape, distinct pages, and for each node (in page order) pages, the share of its commonest text, mean length and links."""

    def __init__(self, tree: Shape, pages: int, stats: list[list[float]]) -> None:
        self.tree, self.pages = tree, pages
        self.stats = {id(x): list(s) for x, s in zip(tree.nodes(), stats, strict=True)}


def induce(layouts: list[Layout]) -> list[dict]:
    """A host's wrappers: shape, content (place of its node in page order) and template (places of template nodes inside it)."""
    left = sorted(layouts, key=lambda x: (-x.pages, json.dumps(x.tree.plain(), ensure_ascii=False)))
    out = []
    while left:
        first, rest = left[0], left[1:]
        aligned = [(x, tree_match(first.tree, x.tree)[1]) for x in rest]
        for other, pairs in aligned:
            for p, q in pairs:
                s, t = first.stats[id(p)], other.stats[id(q)]
                # a text that is common in both layouts is so in all; lengths and links are means
                whole = s[0] + t[0]
                first.stats[id(p)] = [whole, min(s[1], t[1]), *((s[0] * s[i] + t[0] * t[i]) / whole for i in (2, 3))]
        content = _decide(first)[0]
        out.append(_wrapper(first))
        left = [x for x, pairs in aligned if all(p is not content for p, _ in pairs)]
    return out


def _wrapper(first: Layout) -> dict:
    """The wrapper of a layout whose counts those of aligned layouts are added to."""
    content, template = _decide(first)
    place = {id(x): i for i, x in enumerate(first.tree.nodes())}
    return {"shape": first.tree.plain(), "content": place[id(content)], "template": sorted(place[id(x)] for x in template)}


def _decide(layout: Layout) -> tuple[Shape, list[Shape]]:
    stats = layout.stats
    value: dict[int, float] = {}
    nodes = list(layout.tree.nodes())

    def constant(x: Shape) -> bool:
        pages, share, chars, _ = stats[id(x)]
        return pages >= AGREE and share >= CONSTANT and chars > 0

    for x in reversed(nodes):
        _, _, chars, links = stats[id(x)]
        leaf = not x.kids
        value[id(x)] = 0.0 if _is_chrome(x.key) or constant(x) else max(0.0, chars - links) if leaf else sum(value[id(k)] for k in x.kids)
    at = layout.tree
    while at.kids and at.key.partition(".")[0] != "article":
        boxes = sorted((k for k in at.kids if k.key != FLOW and value[id(k)] > 0), key=lambda k: -value[id(k)])
        whole = value[id(at)]
        text = sum(value[id(k)] for k in at.kids if k.key == FLOW)
        if not boxes or value[id(boxes[0])] < MOST * whole or text > (1 - MOST) * OTHER * whole or (len(boxes) > 1 and value[id(boxes[1])] > OTHER * value[id(boxes[0])]):
            break
        at = boxes[0]
    template = [x for x in at.nodes() if x is not at and x.key != FLOW and (constant(x) or (stats[id(x)][0] >= AGREE and stats[id(x)][2] > 0 and stats[id(x)][3] >= LINKS * stats[id(x)][2]))]
    return at, template


def alone(tree: Shape) -> dict:
    """The wrapper of a page on its own."""
    return induce([Layout(tree, 1, [[1, 0.0, x.chars, x.links] for x in tree.nodes()])])[0]


def extract(html: str, wrappers: list[dict] | None) -> str:
    """The main text of one page."""
    tree = shape(parse(html))
    best: tuple[int, dict, list] | None = None
    for w in wrappers or []:
        if "tree" not in w:
            w["tree"] = of_plain(w["shape"])
            w["nodes"] = list(w["tree"].nodes())
        score, pairs = tree_match(w["tree"], tree)
        content = w["nodes"][w["content"]]
        if (best is None or score > best[0]) and any(p is content for p, _ in pairs):
            best = score, w, pairs
    if best is None:
        w = alone(tree)
        nodes = list(tree.nodes())
        content, skip = nodes[w["content"]], [nodes[i] for i in w["template"]]
    else:
        to = {id(p): q for p, q in best[2]}
        nodes = best[1]["nodes"]
        content = to[id(nodes[best[1]["content"]])]
        skip = [to[id(nodes[i])] for i in best[1]["template"] if id(nodes[i]) in to]
    gone = {id(d) for x in skip for d in x.dom}
    return "\n".join(b for d in content.dom for b in blocks(d, gone))


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wrappers: dict[str, list[dict]] = {}
    for batch in batches:
        ids, urls, pages, raw = (batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "wrappers"))
        texts = []
        for i in range(len(pages)):
            w = raw[i].as_py()
            if w is not None and w not in wrappers:
                if len(wrappers) > 1000:
                    wrappers.clear()
                wrappers[w] = json.loads(w)
            texts.append(extract(pages[i].as_py() or "", wrappers.get(w)))
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=_OUT)


_NODE = pa.struct([("node", pa.int32()), ("text", pa.int64()), ("chars", pa.int32()), ("links", pa.int32())])
_SEEN = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("shape", pa.string()), ("page", pa.int64()), ("nodes", pa.list_(_NODE))])
_SEEN_DDL = "host string, layout long, shape string, page long, nodes array<struct<node: int, text: long, chars: int, links: int>>"


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to the layout, its shape (once a task and host), a hash of the page's text, and what its nodes hold."""
    known: set[tuple[str, int]] = set()
    for batch in batches:
        hosts, pages = (batch.column(batch.schema.get_field_index(c)) for c in ("host", "html"))
        cols: list[list] = [[] for _ in _SEEN]
        for host, html in zip(hosts.to_pylist(), pages, strict=True):
            tree = shape(parse(html.as_py() or ""))
            plain = json.dumps(tree.plain(), ensure_ascii=False)
            layout = _hash(plain)
            new = (host, layout) not in known
            if new and len(known) < 1_000_000:
                known.add((host, layout))
            nodes = [{"node": i, "text": x.text, "chars": x.chars, "links": x.links} for i, x in enumerate(tree.nodes())]
            for c, v in zip(cols, (host, layout, plain if new else None, tree.text, nodes), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SEEN, strict=True)], schema=_SEEN)


def _shares(raw: str) -> list[list[float]]:
    """Pages, share of the commonest text, mean length and links of each node of a layout."""
    return [[x["pages"], x["top"] / x["pages"], x["chars"] / x["pages"], x["links"] / x["pages"]] for x in json.loads(raw)]


_ALIGNED_DDL = "host string, layout long, pairs array<struct<node: int, pages: double, share: double, chars: double, links: double>>"
_ALIGNED = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("pairs", pa.list_(pa.struct([("node", pa.int32()), *((c, pa.float64()) for c in ("pages", "share", "chars", "links"))])))])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, layout, shape, stats, first_shape) to the nodes of the host's first layout that match one of this layout, with what that one holds."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shape", "stats", "first_shape")]
        out = []
        for plain, raw, first in zip(*cols, strict=True):
            a, b = of_plain(json.loads(first)), of_plain(json.loads(plain))
            place, held = {id(x): i for i, x in enumerate(a.nodes())}, dict(zip(map(id, b.nodes()), _shares(raw), strict=True))
            out.append([dict(zip(("node", "pages", "share", "chars", "links"), (place[id(p)], *held[id(q)]), strict=True)) for p, q in tree_match(a, b)[1]])
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("host")), batch.column(batch.schema.get_field_index("layout")), pa.array(out, _ALIGNED.field("pairs").type)], schema=_ALIGNED)


def _round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One wrapper of each host from its layouts (host, layout, pages, shape, stats), as induce makes it of the first of them: (host, body, content), and
    the layouts in which its content has no match."""
    order = F.struct((-F.col("pages")).alias("p"), "shape")
    first = materialise(left.groupBy("host").agg(F.min_by(F.struct("layout", "pages", "shape", "stats"), order).alias("f")), "first")
    named = first.select("host", F.col("f.layout").alias("first_layout"), F.col("f.shape").alias("first_shape"))
    others = left.join(named, "host").where("layout <> first_layout").select("host", "layout", "shape", "stats", "first_shape")
    aligned = materialise(others.mapInArrow(_align, _ALIGNED_DDL), "aligned")
    cells = aligned.select("host", F.explode("pairs").alias("x")).groupBy("host", "x.node").agg(F.sum("x.pages").alias("n"), F.min("x.share").alias("share"), F.sum(F.expr("x.pages * x.chars")).alias("chars"), F.sum(F.expr("x.pages * x.links")).alias("links"))
    added = cells.groupBy("host").agg(F.to_json(F.collect_list(F.struct("node", "n", "share", "chars", "links"))).alias("added"))

    def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                stats = _shares(r.stats)
                for x in json.loads(r.added) if r.added else []:
                    s = stats[x["node"]]
                    whole = s[0] + x["n"]
                    stats[x["node"]] = [whole, min(s[1], x["share"]), (s[0] * s[2] + x["chars"]) / whole, (s[0] * s[3] + x["links"]) / whole]
                w = _wrapper(Layout(of_plain(json.loads(r.shape)), int(r.pages), stats))
                rows.append((r.host, json.dumps(w, ensure_ascii=False), w["content"]))
            yield pd.DataFrame(rows, columns=["host", "body", "content"])

    made = first.join(added, "host", "left").select("host", "f.pages", "f.shape", "f.stats", "added").mapInPandas(one, "host string, body string, content int")
    made = materialise(made, "made")
    open_ = aligned.join(made.select("host", "content"), "host").where(~F.exists("pairs", lambda x: x["node"] == F.col("content"))).select("host", "layout")
    return made, materialise(left.join(open_, ["host", "layout"], "left_semi"), "left")


def wrappers(pages: DataFrame, n_layouts: int = LAYOUTS) -> DataFrame:
    """host and wrappers (JSON) of every host, from all its pages. Pages of one layout with equal texts count once. Hosts of up to n_layouts layouts are induced
    in one task each; of others, a round makes one wrapper, and goes on with the layouts that it doesn't fit, until so few are left."""
    seen = materialise(pages.where("host IS NOT NULL").select("host", "html").mapInArrow(_look, _SEEN_DDL), "layouts")
    shapes = seen.where("shape IS NOT NULL").groupBy("host", "layout").agg(F.min("shape").alias("shape"))
    distinct = seen.groupBy("host", "layout", "page").agg(F.first("nodes").alias("nodes"))
    texts = distinct.select("host", "layout", F.explode("nodes").alias("x")).groupBy("host", "layout", "x.node", "x.text").agg(F.count("*").alias("n"), F.sum("x.chars").alias("chars"), F.sum("x.links").alias("links"))
    nodes = texts.groupBy("host", "layout", "node").agg(F.sum("n").alias("pages"), F.max("n").alias("top"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    stats = nodes.groupBy("host", "layout").agg(F.max("pages").alias("pages"), F.to_json(F.array_sort(F.collect_list(F.struct("node", "pages", "top", "chars", "links")))).alias("stats"))
    left = materialise(stats.join(shapes, ["host", "layout"]).select("host", "layout", "pages", "shape", "stats"), "shapes")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        layouts = [Layout(of_plain(json.loads(plain)), int(n), _shares(raw)) for n, plain, raw in zip(pdf["pages"], pdf["shape"], pdf["stats"], strict=True)]
        return pd.DataFrame({"host": [key[0]], "body": [json.dumps(induce(layouts), ensure_ascii=False)[1:-1]]})

    out: list[DataFrame] = []
    while True:
        many = materialise(left.groupBy("host").agg(F.count("*").alias("c")).where(F.col("c") > n_layouts).select("host"), "many")
        few = left.join(many, "host", "left_anti")
        out.append(few.groupBy("host").applyInPandas(one, "host string, body string").withColumn("round", F.lit(2 * len(out))))
        if many.isEmpty():
            break
        made, left = _round(left.join(many, "host", "left_semi"))
        out.append(made.select("host", "body").withColumn("round", F.lit(2 * len(out))))
    if len(out) == 1:
        return out[0].select("host", F.concat(F.lit("["), "body", F.lit("]")).alias("wrappers"))
    parts = reduce(DataFrame.unionByName, out).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("round", "body"))).alias("p"))
    return parts.select("host", F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x["body"]), ","), F.lit("]")).alias("wrappers"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty html give an empty text. A null or odd url has no host: its page is read on its own. Ids may repeat
    or be null; further columns are ignored.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", F.nullif(F.lower(F.regexp_extract("url", _HOST, 1)), F.lit("")))
    known = materialise(wrappers(rows), "wrappers")
    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "wrappers")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLES: dict[str, str] = {}
