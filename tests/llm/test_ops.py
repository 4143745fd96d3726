from __future__ import annotations

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from evidra.llm import components, decontam, exact_dedup, html_text, language, near_dedup, passages, pieces, quality, registry, textvec, token_counts, token_files
from tests.llm.conftest import TEXTS
from tests.oracle import both

BPE, RANKS, MODEL = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf, name):
    ours, theirs = both(spark, registry.queries()[name], registry.oracle_sql()[name], sf)
    assert ours == theirs


# -- 1 token counts


def test_tree_follows_edits():
    c = token_counts.Counter(RANKS, P.PATTERN)
    rng = random.Random(5)
    parts = ["a", "Bc", " ", "  ", "\n", "é", "日", "1", "'s", "the", "!!"]
    some = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    for _ in range(300):
        t = some(rng.choice([5, 50, 900]))
        tree = token_counts.TokenTree(t, c)
        for _ in range(5):
            a = rng.randint(0, len(t))
            b, x = min(len(t), a + rng.choice([0, 1, 3, 60])), some(rng.choice([1, 4, 300]))
            tree.edit(a, b, x)
            t = t[:a] + x + t[b:]
            assert (tree.text, tree.count) == (t, c.whole(t))


def test_edits_touch_little():
    tree = token_counts.TokenTree("word " * 20_000, token_counts.Counter(RANKS, P.PATTERN))
    assert tree.edit(50_000, 50_004, "mot") <= 4 * token_counts.LEAF


def test_count_odd(odd, empty):
    c = token_counts.Counter(RANKS, P.PATTERN)
    got = {r.row_id: r for r in token_counts.count_edited(odd, RANKS, P.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        t = t or ""
        assert got[i].n_tokens == c.whole(t)
        for a, b, x in sorted(token_counts.masking_edits(t), reverse=True):
            t = t[:a] + x + t[b:]
        assert (got[i].n_tokens_edited, got[i].n_chars_edited) == (c.whole(t), len(t))
    assert token_counts.count_edited(empty, RANKS, P.PATTERN).count() == 0


def test_count_given_edits(spark):
    df = spark.createDataFrame([(1, "abc def", [(0, 3, "x"), (2, 5, "overlaps")]), (2, None, None)], "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>")
    got = {r.row_id: r for r in token_counts.count_edited(df, RANKS, P.PATTERN, find=None).collect()}
    assert got[1].n_edits == 1 and got[1].n_chars_edited == 5 and got[2].n_tokens == 0


# -- 2 language


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in language._init(3, rng).items()}
    x, y = rng.integers(0, 256, (7, 4)), np.array([0, 1, 2, 1])
    grad, _ = language._gradients(p, x, y)
    for k in ("Ef", "Ub", "Vf", "W", "b"):
        at = np.unravel_index(np.argmax(np.abs(grad[k])), grad[k].shape)
        was, h = p[k][at], 1e-3
        p[k][at] = was + h
        up = language._gradients(p, x, y)[1]
        p[k][at] = was - h
        down = language._gradients(p, x, y)[1]
        p[k][at] = was
        assert np.isclose((up - down) / (2 * h), grad[k][at], rtol=2e-2, atol=1e-5)


def test_language_learns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = registry.queries()["op2_language_id"](spark, sf).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out AND n_chars > 60").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)


def test_language_odd(odd, empty):
    model = language.train([(b"the cat and the dog " * 6, "en"), ("le chat et la souris é ".encode() * 6, "fr")], steps=30)
    got = {r.row_id: r for r in language.predict(odd, model).collect()}
    assert [i for i in got if got[i].lang_pred == "und"] and all((got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) for i, t in enumerate(TEXTS))
    assert language.predict(empty, model).count() == 0 and language.fit(empty) is None
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
    for only, least in ((None, 0.0), (["fr"], 0.0), (None, 0.8), (["en"], 0.6)):
        want = {i for i in got if got[i].lang_pred != "und" and got[i].score >= least and (only is None or got[i].lang_pred in only)}
        kept = language.drop_unknown(odd, model, languages=only, least=least)
        assert {r.doc_id for r in kept.collect()} == want and kept.columns == odd.columns
    lettered = {i for i, t in enumerate(TEXTS) if any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in language.drop_unknown(odd, None).collect()} == lettered
    twice = odd.unionAll(odd).withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(4)).cast("long"))
    assert language.drop_unknown(twice, None).count() == 2 * len(lettered)


# -- 3 passages


@pytest.mark.parametrize("ties", [False, True])
def test_windows(ties):
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = rng.integers(0, 60, 4)
        begin = np.concatenate([[0], np.cumsum(n)])
        h = rng.integers(1, 40 if ties else 10**15, begin[-1]).astype(np.uint64) | np.uint64(1)
        got = set(zip(*[x.tolist() for x in passages.compact_windows(h, begin, 7)], strict=True))
        want = set()

        def split(d, v, a, b):
            if b - a + 1 >= 7:
                c = min(range(a, b + 1), key=lambda i: (v[i], i))
                want.add((d, a, c, b))
                split(d, v, a, c - 1)
                split(d, v, c + 1, b)

        for d in range(4):
            v = h[begin[d] : begin[d + 1]].tolist()
            split(d, v, 0, len(v) - 1)
            for i in range(len(v) - 6):
                m = min(v[i : i + 7])
                assert any(e == d and a <= i and b >= i + 6 and v[c] == m for e, a, c, b in got)
        assert ties or got == want


def test_passages(spark, corpus, sf):
    got = registry.queries()["op3_repeated_passages"](spark, sf).collect()
    words = {i: re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for i, t in corpus.items()}
    seen = defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - 49):
            seen[tuple(w[j : j + 50])].add(i)
    want = {i for g in seen.values() if len(g) > 1 for i in g}
    assert want <= {r.doc_id for r in got}
    for r in got:
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words[r.doc_id][r.start_word : r.end_word], words[r.other_id][r.other_start : r.other_end]))
        assert min(r.end_word - r.start_word, r.other_end - r.other_start) >= 50 and len(a & b) >= 0.75 * len(a | b) and r.doc_id != r.other_id


def test_passages_planted(spark):
    rng = random.Random(2)
    text = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    shared = text(60)
    rows = [(i, " ".join(text(200) + shared + text(150))) for i in range(6)] + [(i, " ".join(text(300))) for i in range(6, 12)] + [(12, "short"), (13, None), (14, "")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in got} == set(range(6)) and all(r.start_word <= 200 and r.end_word >= 260 for r in got)
    copies = spark.createDataFrame([(i, " ".join(shared)) for i in range(4)], "doc_id long, text string")
    assert {(r.doc_id, r.other_id) for r in passages.repeated_passages(copies).collect()} == {(0, 3), (1, 0), (2, 0), (3, 0)}


def test_passages_behind_recurring_phrases(spark):
    """Each phrase of the passages also stands in earlier documents, in unlike surroundings."""
    rng = random.Random(7)
    text = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for _ in range(4):
        shared = text(50)
        rows += [" ".join(text(60) + shared[k : k + 5] + text(60)) for k in range(46) for _ in range(3)]
        for _ in range(3):
            want.add((shared[0], len(rows)))
            rows.append(" ".join(text(80) + shared + text(80)))
    # the sharing documents come last
    late = sorted(i for _, i in want)
    order = [i for i in range(len(rows)) if i not in late] + late
    df = spark.createDataFrame([(k, rows[i]) for k, i in enumerate(order)], "doc_id long, text string").repartition(5)
    got = passages.repeated_passages(df).collect()
    assert {order[r.doc_id] for r in got} == set(late)
    assert len(got) == len({tuple(r) for r in got})


def test_passages_odd(odd, empty):
    assert passages.repeated_passages(odd).count() == 0 and passages.repeated_passages(empty).count() == 0


# -- 4 pieces


def test_pieces_equal_library():
    import sentencepiece

    ours, theirs = pieces.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "é", "日", "1", "the", "ing", "▁", "\x00", "𝄞", "<s>", "er", "!!"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t or "" for t in TEXTS]
    for t in texts:
        ids = ours.encode(t)
        assert np.frombuffer(ids, ours.dtype).tolist() == theirs.encode(t)
        assert ours.decode(ids).decode() == t.replace("▁", " ")


def test_long_words_equal_library():
    """Words far longer than the window, with characters that no piece covers."""
    import sentencepiece

    ours, theirs = pieces.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(4)
    parts = ["a", "er", "ing", "the", "B", "é", "ß", "日", "𝄞", "1", "xx", "-", "tion"]
    for n in (70, 300, 2000, 9000):
        t = "".join(rng.choice(parts) for _ in range(n))
        assert np.frombuffer(ours.encode(t), ours.dtype).tolist() == theirs.encode(t)


def test_commits_early():
    runs = list(pieces.load(MODEL).committed("▁" + "thequickbrownfox" * 400))
    assert len(runs) > 50 and max(map(len, runs)) < 100


def test_pieces_odd(odd, empty):
    got = {r.row_id: r for r in pieces.encode(odd, MODEL).collect()}
    assert got[0].n_tokens == got[1].n_tokens == 0 and all(got[i].round_trip == ("▁" not in (t or "")) for i, t in enumerate(TEXTS))
    assert pieces.encode(empty, MODEL).count() == 0


# -- 5 html


def page(i, body):
    return f"<html><head><title>t{i}</title></head><body><header>Site</header><div class='menu'><a>m{i}</a></div>{body}<footer>f</footer></body>"


def test_html_rules():
    t = "<div class=menu><a>x</a></div><div id=content><h2>T &eacute;</h2><p>One  two<br>three<p>Four <b>bold</b>, x &amp; y<ul><li>i1<li>i2</ul><form>f</form><div class='comments'>c</div></div><aside>s</aside>"
    assert html_text.extract(t, None) == "T é\nOne two\nthree\nFour bold, x & y\ni1\ni2"
    assert html_text.extract("<p>a<script>var x='<p>'</script>b", None) == "ab"
    assert html_text.extract("", None) == "" and html_text.extract("plain < text", None) == "plain < text"


def layouts_of(pages):
    """What the aggregates of the operator give for the pages of one host."""
    by = defaultdict(dict)
    for p in pages:
        tree = html_text.shape(html_text.parse(p))
        by[str(tree.plain())].setdefault(tree.text, tree)
    out = []
    for trees in (list(x.values()) for x in by.values()):
        stats = []
        for same in zip(*(t.nodes() for t in trees), strict=True):
            top = Counter(x.text for x in same).most_common(1)[0][1]
            stats.append([len(same), top / len(same), sum(x.chars for x in same) / len(same), sum(x.links for x in same) / len(same)])
        out.append(html_text.Layout(trees[0], len(trees), stats))
    return out


def plain_page(i, extra=""):
    """Nothing but div and p: the menu, advert and foot change from page to page, the notice does not."""
    rng = random.Random(i)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    menu = "".join(f"<a href=/{k}>{say(2)}</a> " for k in range(6))
    body = f"<h1>{say(4)}</h1><p>{say(40)}</p><div>Read this first, on every page</div><h2>{say(3)}</h2><p>{say(60)}</p>"
    want = [" ".join(x.split()) for x in re.findall(r"<(?:h1|h2|p)>(.*?)</", body)]
    return f"<html><body><div>{menu}</div><div>{say(5)}</div>{extra}<div>{body}</div><div>{say(7)}</div></body></html>", "\n".join(want)


def test_only_alignment_tells(spark):
    """Plain div pages of one host: right with the wrapper of the host, wrong without."""
    made = [plain_page(i) for i in range(12)] + [plain_page(i, f"<div><div>Sale {i}</div><div>now</div></div>") for i in range(12, 18)]
    w = html_text.induce(layouts_of([p for p, _ in made]))
    assert all(html_text.extract(p, w) == t for p, t in made)
    assert all(html_text.extract(p, None) != t for p, t in made)
    rows = [(i, f"http://plain.example/{i}", p) for i, (p, _) in enumerate(made)]
    for parts in (1, 3):
        got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts))
        assert {r.page_id: r.text for r in got.collect()} == {i: t for i, (_, t) in enumerate(made)}


def test_two_layouts_of_a_host():
    """Layouts whose contents do not align have wrappers of their own; a line that all articles share stays."""
    one = [f"<body><div class=x><section><p>story {i} of {i * 7} {'long ' * 30}</p><p>Always the same line</p></section></div><div>{i}</div></body>" for i in range(6)]
    two = [f"<body><main><div><div><p>tale {i} {'much ' * 30}</p></div></div></main></body>" for i in range(4)]
    w = html_text.induce(layouts_of(one + two))
    assert len(w) == 2
    assert html_text.extract(one[3], w) == f"story 3 of 21 {'long ' * 29}long\nAlways the same line"
    assert html_text.extract(two[1], w) == f"tale 1 {'much ' * 29}much"


@pytest.mark.parametrize("n_layouts", [None, 1, 4, 20])
def test_all_layouts_of_a_host_count(spark, n_layouts):
    """Twenty-one layouts of one host, the last with a content of its own: the wrappers are those of the plain loop over all, in however many rounds."""
    one = [plain_page(i, f"<section class=k{i % 20}><div>{i % 3 and i}</div></section>")[0] for i in range(100)]
    two = [f"<body><main><div>Same line</div><div><div><p>tale {i} {'much ' * 30}</p></div></div></main></body>" for i in range(4)]
    want = html_text.induce(layouts_of(one + two))
    rows = [("big.example", p) for p in one + two] + [("small.example", p) for p in one[:3]] + [(None, one[0])]
    df = spark.createDataFrame(rows, "host string, html string").repartition(3)
    got = {r.host: json.loads(r.wrappers) for r in html_text.wrappers(df, *([n_layouts] if n_layouts else [])).collect()}
    assert len(want) > 1 and got == {"big.example": want, "small.example": html_text.induce(layouts_of(one[:3]))}


def test_matching():
    a, b = (html_text.shape(html_text.parse(x)) for x in ("<div>a<section>b</section></div><div>c</div>", "<div>a<section>b</section></div><main>m</main><div>c<div>d</div></div>"))
    assert html_text.tree_match(a, b)[0] == 7
    assert html_text.of_plain(a.plain()).plain() == a.plain()
    table = html_text.TABLE
    try:
        html_text.TABLE = 0
        assert html_text.tree_match(a, b)[0] == 7
    finally:
        html_text.TABLE = table


def test_many_children_are_matched_in_full():
    """Above TABLE pairs of children the score is that of the whole table, and the pairs are as many and keep order."""
    shape = html_text.Shape
    boxes = lambda: [shape("div", [shape("p") for _ in range(i % 3)]) for i in range(600)]
    assert html_text.tree_match(shape("body", [shape("nav"), *boxes()]), shape("body", [*boxes(), shape("nav")]))[0] == 1201
    rng = random.Random(3)

    def tree(depth):
        return shape(rng.choice("abc"), [tree(depth - 1) for _ in range(rng.randint(0, 5))] if depth else [])

    table = html_text.TABLE
    for _ in range(60):
        a, b = shape("r", [tree(2) for _ in range(9)]), shape("r", [tree(2) for _ in range(8)])
        want = html_text.tree_match(a, b)[0]
        try:
            html_text.TABLE = 0
            score, pairs = html_text.tree_match(a, b)
        finally:
            html_text.TABLE = table
        left, right = ({id(x): i for i, x in enumerate(t.nodes())} for t in (a, b))
        places = sorted((left[id(p)], right[id(q)]) for p, q in pairs)
        assert score == want == len(pairs) and all(p.key == q.key for p, q in pairs)
        assert all(p < q and x < y for (p, x), (q, y) in zip(places, places[1:], strict=False))


@pytest.mark.parametrize("depth", [50, 101, 4000])
def test_deep_pages_follow_one_rule(depth):
    pages = [f"<body><div><a href=x>menu {i} {i * i}</a></div>{'<div>' * depth}<p>text {i} {'and ' * 20}</p>{'<div>x</div>' * 2}" for i in range(5)]
    w = html_text.induce(layouts_of(pages))
    assert [html_text.extract(p, w) for p in pages] == [f"text {i} {'and ' * 19}and" for i in range(5)]


def test_html_odd(spark):
    rows = [(i, u, h) for i, (u, h) in enumerate([("http://a.b/x", None), (None, ""), ("no url", "<p>x"), ("http://a.b/y", "<div>" * 5000 + "deep"), ("http://a.b/z", "</p></div>&nbsp;<![CDATA[<p>"), ("http://a.b/x", "<article><p>copy</p></article>"), ("http://a.b/x", "<article><p>copy</p></article>")])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "host": F.lit("h")})
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert [got[i].text for i in (0, 1, 2, 3, 5, 6)] == ["", "", "x", "deep", "copy", "copy"] and all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.main_text(df.where("false")).count() == 0


def test_html_whole_articles(spark, sf):
    import html as H

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in registry.queries()["op5_html_extraction"](spark, sf).collect():
        art = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = [" ".join(H.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", art)]
        assert r.text == "\n".join(b for b in want if b)


# -- 6 exact


def test_trie():
    rng = random.Random(1)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(800)]
    trie = exact_dedup.Patricia()
    for i, k in enumerate(keys):
        n = trie.terminal(k)
        n.owner = 0
        n.low, n.count = exact_dedup._lower(n.low, (i, i)), n.count + 1
    assert {k: (n.low[0], n.count) for k, n in trie.terminals()} == {k: (keys.index(k), c) for k, c in Counter(keys).items()}


def test_exact_odd(odd, empty):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(odd).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in TEXTS]
    for i, t in enumerate(norm):
        assert (got[i].keep_id, got[i].group_size, got[i].text_sha256) == (norm.index(t), norm.count(t), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_exact(odd).columns == odd.columns and exact_dedup.drop_exact(odd).count() == len(set(norm))


def test_exact_repeated_null_and_shared_ids(spark):
    rows = [(1, "a b", "x")] * 4 + [(None, "a  b", "y"), (None, "c", "z"), (None, "c", "z"), (2, "a\tb", "y"), (3, "c", "p"), (3, "d", "q"), (4, None, "r"), (5, "", "s"), (5, "d", "t")]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    low = {t: min(r[0] for r, u in zip(rows, norm, strict=True) if u == t and r[0] is not None) for t in norm}
    for parts in (1, 2, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string, row_id string").repartition(parts)
        got = exact_dedup.exact_groups(df).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((r[0], low[t], norm.count(t), hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, norm, strict=True))
        assert sum(r.kept for r in got) == len(low) and all(r.doc_id == r.keep_id for r in got if r.kept)
        kept = exact_dedup.drop_exact(df)
        assert kept.schema == df.schema
        assert Counter((re.sub(r"\s+", " ", r.text or ""), r.doc_id) for r in kept.collect()) == Counter(low.items())


def test_drop_exact_spills(spark, monkeypatch, corpus):
    monkeypatch.setattr(exact_dedup, "SPILL_BYTES", 2_000)
    df = spark.createDataFrame(sorted(corpus.items()), "doc_id long, text string").repartition(3)
    first = {}
    for i, t in sorted(corpus.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    assert {r.doc_id: r.text for r in exact_dedup.drop_exact(df).collect()} == {i: corpus[i] for i in first.values()}


def test_spill_changes_nothing(monkeypatch):
    import pyarrow as pa

    rows = [(i, i, 5, "s", (t or "").encode()) for i, t in enumerate(TEXTS * 3)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["row", "row_id", "hash", "sha", "body"])
    monkeypatch.setattr(exact_dedup, "SPILL_ROWS", 4)
    out = pa.Table.from_batches(list(exact_dedup.local_tries(iter([batch.slice(i, 3) for i in range(0, len(rows), 3)])))).to_pylist()
    assert len(out) == len(rows)
    terminals = sorted((r for r in out if r["n"] is not None), key=lambda r: (r["size"], r["hash"]))
    merged = pa.Table.from_batches(list(exact_dedup.merged_tries(iter(pa.Table.from_pylist(terminals).to_batches(2))))).to_pylist()
    keep = {r["o"]: (r["keep"], r["total"]) for r in merged}
    text = [(t or "") for t in TEXTS * 3]
    assert all(keep[r["owner"]] == (text.index(text[r["row_id"]]), text.count(text[r["row_id"]])) for r in out)


# -- 7 quality


def test_quality_separates(spark, sf):
    known = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = registry.queries()["op7_quality_classifier"](spark, sf).join(known, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.85 and all(r.predicted == int(r.score >= 0.5) for r in got)


def test_quality_odd(odd, empty, spark):
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 1), (4, 1), (8, None), (9, 7)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    got = {r.row_id: r.score for r in quality.score(odd, model).collect()}
    assert len(got) == len(TEXTS) and got[0] == got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    assert quality.fit(empty, labels) is None and {r.score for r in quality.score(odd, None).collect()} == {0.5}


# -- 8 decontamination


def brute_hits(text, items, size=10):
    w = [x for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    hit, found = set(), set()
    for item, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for j in range(max(1, len(v) - size + 1) if v else 0):
            x = v[j : j + size]
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_hits(spark, odd, block):
    items = [(1, "one TWO three"), (2, None), (3, "..."), (20, " ".join(f"w{i}" for i in range(100, 130))), (4, "ß-日本"), (5, "four five six"), (6, "three four")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.row_id: r for r in decontam.find_benchmark(odd, bench, block_bytes=block).collect()}
    for i, t in enumerate(TEXTS):
        n, hit, who = brute_hits(t, items)
        assert (found[i].n_words, sum(b - a for a, b in found[i].runs), found[i].items) == (n, hit, who)
        for a, b in found[i].spans:
            assert t[a:b] == t[a:b].strip() != ""
    twice = odd.unionAll(odd).withColumn("doc_id", F.lit(1).cast("long"))
    assert decontam.find_benchmark(twice, bench, block_bytes=block).count() == 2 * len(TEXTS)
    kept = decontam.drop_contaminated(twice, bench, block_bytes=block)
    assert kept.columns == odd.columns and kept.count() == 2 * sum(not brute_hits(t, items)[1] for t in TEXTS)


def test_no_benchmark(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontam.find_benchmark(empty, bench).count() == 0
    assert decontam.drop_contaminated(odd, bench.where("false")).count() == len(TEXTS)


# -- 9 token files


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((0, 1), (1, 1), (5, 3), (3000, 10**9), (3000, 50), (700, 2**40)):
        v = np.sort(rng.integers(0, u, n))
        raw = token_files.EliasFano.of(v).to_bytes()
        ef = token_files.EliasFano.from_bytes(raw)
        assert (ef.all() == v).all() and all(ef.select(i) == v[i] for i in range(0, n, 3))
        assert len(raw) * 8 <= 200 + n * (3 + max(0, np.log2(max(u, 1) / max(n, 1))))


def test_cut_pieces_equal_library():
    e = token_files.PieceEncoder(BPE)
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "日", "1", "'s", "\x1c", "\x85", "<|endoftext|>", "!", "\x01", "𝄞"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    for some in (texts, [t for t in texts if t.strip()], ["", "a b"], [""], []):
        raw = [t.encode() for t in some]
        got = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [x.tolist() for x in got] == [x.tolist() for x in e.whole(some)]


def test_token_files_round_trip(odd, empty, spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    token_files.write_tokens(odd, str(tmp_path / "t"), BPE)
    got = {r.row_id: r for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect()}
    at = 0
    for i, t in enumerate(TEXTS):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    token_files.write_tokens(empty, str(tmp_path / "e"), BPE)
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_added_tokens_equal_plain_library(spark, tmp_path):
    """Texts with an added token's content against a Tokenizer as it is loaded."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    assert tok.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts = ["a <|endoftext|> b", "plain text here", "", "<|endoftext|>", "x<|endoftext|>y\nz <|endoftext|>", "<|endoftext", "|> b", "<|endoftext |>", "one two<|endoftext|>"] * 3
    raw = [t.encode() for t in texts]
    e = token_files.PieceEncoder(BPE)
    for _ in range(2):
        got = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [x.tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    token_files.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "t"), BPE)
    read = {r.row_id: r for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (read[i].start, read[i].n_tokens, read[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# -- 10 near duplicates


def shingles(t):
    low = (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    w = re.findall(rb"[^\x20\x09-\x0d]+", low)
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(sets):
    uf = components.UnionFind()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            uf.union(a, b)
    return {i: uf.find(i) for i in sets}


def test_superminhash_estimates():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        n, k = int(rng.integers(5, 700)), float(rng.uniform(0.3, 1))
        common = rng.integers(0, 2**63, int(n * k), dtype=np.uint64)
        x, y = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)])) for _ in "ab")
        sig = near_dedup.superminhash(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        errors.append((sig[0] == sig[1]).mean() - j)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045


def test_near_equals_brute(spark, corpus, sf):
    sets = {i: shingles(t) for i, t in corpus.items()}
    want = brute_components(sets)
    for r in registry.queries()["op10_near_dedup"](spark, sf).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_chain_and_copies(spark):
    """A chain whose ends are far apart is one group; a large group of copies and edits, too."""
    rng = random.Random(7)
    base = [f"t{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for k in range(12):
        texts.append(" ".join(base))
        at = 20 * k
        base[at : at + 8] = [f"n{k}_{i}" for i in range(8)]
    texts += ["alpha beta gamma delta epsilon zeta"] * 5 + [None, "", "only three words", "ONLY three  words"]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    got = near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    want = brute_components(sets)
    assert {r.doc_id: r.component_id for r in got} == want and want[11] == 0


def test_near_unlike_signatures(spark):
    """Pairs at similarity 0.75 that share a bucket, with under 62 % of equal slots."""
    texts = []
    for seed in (12702, 20852):
        r = random.Random(seed)
        w = [f"{r.getrandbits(30):x}" for _ in range(1604)]
        texts += [" ".join(w[:1404]), " ".join(w[200:])]
    got = near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_near_odd(odd, empty):
    want = brute_components({i: shingles(t) for i, t in enumerate(TEXTS)})
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(odd).collect()} == want
    assert near_dedup.near_groups(empty).count() == 0 and near_dedup.drop_near(odd).columns == odd.columns


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    uf = components.UnionFind()
    for a, b in edges:
        uf.union(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {n: uf.find(n) for n in uf.up if any(n in e and e[0] != e[1] for e in edges)}


def test_word_hashes():
    texts = ["a bb  ccc", "", "bb", " ccc a bb "]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    s, e, first = textvec.words(data, off)
    h = textvec.word_hashes(data, s, e)
    names = [bytes(data[a:b]) for a, b in zip(s, e, strict=True)]
    assert names == [w for t in raw for w in t.split()] and np.diff(first).tolist() == [len(t.split()) for t in raw]
    assert len({n: x for n, x in zip(names, h.tolist(), strict=True)}) == len(set(h.tolist())) == 3


# -- pipeline


def test_pipeline_equals_brute(spark, sf, corpus):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = {r.row_id for r in language.predict(docs, language.fit(docs)).where(f"lang_pred <> 'und' AND score >= {language.LEAST}").collect()}
    assert len(known) > 0.97 * sum(any(c.isalpha() for c in t or "") for t in corpus.values())
    kept = {i: t for i, t in corpus.items() if i in known}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in kept.items()}
    first = {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    kept = {i: kept[i] for i in first.values()}
    root = brute_components({i: shingles(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if root[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    size = 10
    windows = {w.decode() for _, t in items for w in decontam.windows((t or "").encode(), size)}
    clean = {i for i, t in kept.items() if not any(w in f" {b' '.join(decontam.word_list(t.encode())).decode()} " for w in windows)}
    out = cp.run(spark, sf)
    assert {r.doc_id for r in out.collect()} == clean and out.where("NOT round_trip").count() == 0
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs.where("false"), sf).columns == docs.columns
    assert [n for n, _ in cp.STAGES] == ["language", "exact_dedup", "near_dedup", "decontaminate", "encode"]
