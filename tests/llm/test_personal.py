"""Personal data: base patterns against plain ones, the field against enumeration and planted spellings."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from evidra.llm import personal as pe


def brute_base(text):
    """The base spans by the contract's patterns as they stand."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_base_equals_patterns(seed):
    rng = random.Random(seed)
    pieces = ["a@b.c", "x.y+z@h-1.co.uk", "@", "a@b", "@d.e", ".", "..", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111111111111111", "4111 1111-1111 1111", "411111111111111", "-", " ", "+1 (743) 555-3824", "+", "()", "é", "٣", "\n", "99", "+12345678)", "%", "٤@x.y", "4111  1111"]
    for _ in range(3000):
        t = "".join(rng.choices(pieces, k=rng.randrange(1, 9)))
        assert pe.base_spans(t) == brute_base(t), t


def test_base_on_corpus(corpus):
    texts = [t for t in corpus.values() if t]
    assert sum(len(pe.base_spans(t)) for t in texts) > 10
    assert all(pe.base_spans(t) == brute_base(t) for t in texts)


def test_long_texts_are_linear():
    for t in ("1" * 400_000, "x" * 400_000, "a." * 200_000, "+1" * 200_000, "1." * 200_000, "@" * 200_000, "a@b " * 50_000):
        pe.base_spans(t)
        if len(set(t)) < 3 and " " not in t:
            pe.consistent_spans([t], [pe.base_spans(t)], pe.Field())


def test_propagation_is_exact_on_trees():
    rng = np.random.default_rng(3)
    unary, table = rng.normal(size=(5, pe.LABELS)), rng.normal(size=(4, pe.LABELS, pe.LABELS))
    edges = np.array([(0, 1, 0), (1, 2, 0), (0, 3, 2), (1, 4, 1)])
    p = np.zeros((5, pe.LABELS))
    for ys in itertools.product(range(pe.LABELS), repeat=5):
        w = np.exp(sum(unary[i, y] for i, y in enumerate(ys)) + sum(table[t, ys[a], ys[b]] for a, b, t in edges))
        for i, y in enumerate(ys):
            p[i, y] += w
    got = pe._soft(pe.propagate(unary, edges, table, 60)[0], (1,))
    assert np.allclose(got, p / p.sum(axis=1, keepdims=True), atol=1e-4)


def test_loops_converge():
    rng = np.random.default_rng(4)
    unary, table = rng.normal(size=(6, pe.LABELS)), pe.Field().potentials()
    edges = np.array([(i, j, 1) for i in range(6) for j in range(i)])
    a, b = (pe._soft(pe.propagate(unary, edges, table, n)[0], (1,)) for n in (40, 41))
    assert np.abs(a - b).max() < 1e-3


@pytest.fixture(scope="module")
def model(corpus):
    texts = [t for _, t in sorted(corpus.items()) if t]
    return pe.train([x for t in texts for x in pe.examples_of(t)])


def added(model, text):
    base = pe.base_spans(text)
    spans = pe.consistent_spans([text], [base], model)[0]
    assert set(base) <= set(spans) and spans == sorted(spans)
    return [(pe.KINDS[k], text[s:e]) for k, s, e in spans if (k, s, e) not in base]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Call +1 (743) 555-3824 today or 743-555-3824 then, never 212-555-9917.", [("phone", "743-555-3824")]),
        ("7435553824 is the same as +1 (743) 555-3824", [("phone", "7435553824")]),
        ("ring (743) 555-3824 " + "word " * 3000 + "+1 743 555 3824", [("phone", "(743) 555-3824")]),
        ("card 4316522678525456, again 4316.5226.7852.5456, not 4316.5226.7852.5111", [("card", "4316.5226.7852.5456")]),
        ("host 70.23.22.57 as 70-23-22-57 but 70-23-22-58", [("ip", "70-23-22-57")]),
        ("write to hein.19@mail5.example.com; HEIN.19 answers, hein.20 does not", [("email", "HEIN.19")]),
        ("no link: (743) 555-3824, 4316.5226.7852.5455, 70-23-22-57, hein.19", []),
        ("Version 1.2.3 of 2024-01-02 10:30, 12345 items, 3 of 7, 1/2 cup, 24be64439e3e49", []),
        ("", []),
    ],
)
def test_repeats_are_found_and_look_alikes_are_not(model, text, want):
    assert added(model, text) == want


def test_few_additions_on_the_corpus(model, corpus):
    """Documents without any base span get nothing."""
    for t in corpus.values():
        if t and not pe.base_spans(t) and not any(len(re.sub("[^0-9]", "", t[s:e])) > 19 for _, s, e, _ in pe.matches(t)):
            assert added(model, t) == []


def test_no_entities_no_model(spark, odd, empty):
    assert pe.train([]) is None
    assert pe.fit(empty) is None
    rows = pe.find_personal(odd, None).collect()
    assert len(rows) == odd.count() and all(r.spans == r.base for r in rows)
    assert pe.find_personal(empty, None).collect() == []


def test_query(spark, sf, corpus):
    from evidra.llm import registry

    rows = registry.queries()["op12_personal_data"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(corpus)
    for r in rows:
        base = brute_base(corpus[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        text = ",".join(f"{pe.KINDS[k]}:{s}:{e}" for k, s, e in sorted(base))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a@b.cd"), (1, "a@b.cd"), (1, None)], "doc_id long, text string")
    assert sorted((r.row_id is None, r.n_email, r.spans) for r in pe.find_personal(df, None).collect()) == [(False, 0, ""), (False, 1, "email:0:6"), (True, 1, "email:0:6")]
