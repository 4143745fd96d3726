from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from evidra.functions import scalars as sc
from evidra.functions import text as tx
from evidra.operators import quality as qu
from evidra.operators import retrieval as re_


def only(df):
    return df.collect()[0][0]


def value(spark, column):
    return only(spark.range(1).select(column))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Supported claim. Invented claim.", ["Supported claim.", "Invented claim."]),
        ('He said "Stop." Then left.', ['He said "Stop."', "Then left."]),
        ("no capital. after this", ["no capital. after this"]),
        ("  One!  2 more? ", ["One!", "2 more?"]),
        ("", []),
    ],
)
def test_sentences(spark, text, want):
    assert [text[r.start : r.end] for r in value(spark, tx.sentences(F.lit(text)))] == want


END = re.compile(r"(?<=[.!?])(?:[\"'”’\])]*)\s+(?=[A-Z0-9\"'“‘\[(])")


def cut(text):
    """Sentence ranges by a plain loop."""
    edges = [0, *(m.end() for m in END.finditer(text)), len(text)]
    out = [(a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in zip(edges[:-1], edges[1:], strict=True) if text[a:b].strip()]
    return out


def test_sentences_equal_brute(spark):
    rng = random.Random(3)
    parts = ["a", "B", "é", ".", "!", "? ", " ", "\n", '"', "”", ")", "(", "7", "x. Y", "\x1c", "\xa0", "𝄞", "... ", "'"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["One. " * 1500, "word " * 3000 + "end. Next one."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [(x.start, x.end) for x in r.s] for r in df.select("i", tx.sentences("t").alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [cut(t) for t in texts]


def test_ranges_join_under_a_span(spark):
    def joined(ranges, spans):
        kind = "array<struct<start:int,end:int>>"
        row = spark.createDataFrame([(ranges, spans)], f"r {kind}, s {kind}")
        return [tuple(x) for x in row.select(tx.joined_ranges(F.col("r"), F.col("s")).alias("x")).first().x]

    assert joined([(0, 5), (6, 10), (11, 20)], [(3, 7)]) == [(0, 10), (11, 20)]
    assert joined([(0, 5), (6, 10)], [(0, 5), (6, 8)]) == [(0, 5), (6, 10)]
    assert joined([(0, 5), (6, 10)], []) == [(0, 5), (6, 10)]


def test_labelled_claims(spark):
    text = "Alpha is here now. Beta follows it closely. Ok. Gamma ends all this."
    df = spark.createDataFrame([(1, text, [(10, 25)]), (2, text, None), (3, "", None)], "id long, t string, s array<struct<start:int,end:int>>")
    got = {(r.id, r.claim_index): (r.claim, r.label) for r in re_.labelled_claims(df, "id", "t", "s").collect()}
    assert got == {(1, 0): ("Alpha is here now. Beta follows it closely.", True), (1, 2): ("Gamma ends all this.", False), (2, 0): ("Alpha is here now.", False), (2, 1): ("Beta follows it closely.", False), (2, 3): ("Gamma ends all this.", False)}
    whole = re_.labelled_claims(df, "id", "t", "s", granularity="response").collect()
    assert {(r.id, r.claim, r.label) for r in whole} == {(1, text, True), (2, text, False)}


def test_flatten_json():
    assert tx.flatten_value({"a": {"b": [1, {"c": "x"}]}, "d": None, "e": " "}) == ["a.b[0]: 1", "a.b[1].c: x", "d: null", "e:  "]


def test_flatten_deep_and_bare():
    deep = want = None
    for _ in range(5000):
        deep, want = [deep], f"[0]{want or ''}"
    assert tx.flatten_value(deep) == [f"{want}: null"]
    assert tx.flatten_value("x") == ["x"] and tx.flatten_value(None) == ["null"] and tx.flatten_value({}) == tx.flatten_value([]) == []
    assert tx.flatten_value({"b": {"z": True, "a": 1.5}, "a": [[], [0]]}) == ["b.z: True", "b.a: 1.5", "a[1][0]: 0"]


def test_evidence_units(spark):
    rows = [("QA", "passage 1: a b\npassage 3: c"), ("Summary", "One is. Two is. Three is. Four is. Five is. Six is."), ("Summary", "Only one."), ("Data2txt", '{"k": [null, "v"], "n": true}'), ("QA", None)]
    got = [r.u for r in spark.createDataFrame(rows, "task string, source string").coalesce(1).select(tx.evidence_units("task", "source").alias("u")).collect()]
    assert got == [["a b", "c"], ["One is. Two is. Three is.", "Three is. Four is. Five is.", "Five is. Six is."], ["Only one."], ["k[0]: null", "k[1]: v", "n: True"], []]
    with pytest.raises(Exception, match="unknown task"):
        spark.createDataFrame([("X", "y")], "task string, source string").select(tx.evidence_units("task", "source")).collect()


@pytest.mark.parametrize(("source", "target", "want"), [("a b", "a a b", "low"), ("a a a b", "a a a b", "none"), ("x", "a a a a", "high"), ("a a a", "a a a a", "medium"), ("x y", "a a a", "medium"), ("x", "p q p q p q p q", "high"), ("", "", "none")])
def test_severity(spark, source, target, want):
    df = qu.pair_flags(spark.createDataFrame([(source, target)], "s string, t string"), "s", "t")
    assert df.first().repetition == want


@pytest.mark.parametrize(("text", "unit", "want"), [("a a a a a proposta", 1, 5), ("x y x y x y", 2, 3), ("q x y x y", 2, 2), ("one", 1, 1), ("one", 3, 1), ("", 1, 0), ("a b c", 1, 1), ("A a b", 1, 2)])
def test_runs(spark, text, unit, want):
    assert value(spark, tx.longest_run(F.lit(text), unit)) == want


def test_passages(spark):
    assert value(spark, tx.passages(F.lit("passage 1: a\npassage 3: c"))) == ["a", "c"]
    assert value(spark, tx.passages(F.lit("p one\n\np two"))) == ["p one", "p two"]
    assert [tuple(x) for x in value(spark, tx.indexed_passages(F.lit("passage 1: a\npassage 3:  c\n d")))] == [(0, "a"), (2, "c d")]
    assert [tuple(x) for x in value(spark, tx.indexed_passages(F.lit("p one\n\n \n\np two")))] == [(0, "p one"), (1, "p two")]


def test_lengths(spark):
    m = tx.length_metrics(F.lit("x" * 100), F.lit("x" * 5))
    assert value(spark, m["low_ratio"]) is True and value(spark, m["high_ratio"]) is False
    m = tx.length_metrics(F.lit("a  b"), F.lit(" ab "))
    assert value(spark, m["ratio"]) == 1.0 and value(spark, m["source_words"]) == 2
    assert value(spark, tx.length_metrics(F.lit(""), F.lit(" "))["target_empty"]) is False and value(spark, tx.length_metrics(F.lit("x"), F.lit(" "))["target_empty"]) is True
    m = tx.length_metrics(F.lit(""), F.lit("abc"))
    assert value(spark, m["ratio"]) is None and value(spark, m["low_ratio"]) is False


def test_overlap_is_half_open(spark):
    assert value(spark, sc.overlap(F.lit(0), F.lit(2), F.lit(2), F.lit(5))) == 0
    assert value(spark, sc.overlap(F.lit(0), F.lit(9), F.lit(4), F.lit(5))) == 1


def test_same_float(spark):
    nan, null = F.lit(float("nan")), F.lit(None).cast("double")
    assert value(spark, sc.same_float(nan, nan)) and value(spark, sc.same_float(null, null))
    assert value(spark, sc.same_float(F.lit(1.0), F.lit(1.0 + 1e-8))) and not value(spark, sc.same_float(F.lit(1.0), null))


def test_labels_and_flags(spark):
    assert value(spark, sc.binary_label(F.lit(True))) == 1 and value(spark, sc.flag(F.lit(" False "))) is False
    with pytest.raises(Exception, match="binary label"):
        value(spark, sc.binary_label(F.lit(2)))


def test_slots(spark):
    got = value(spark, sc.padded_slots(F.array(F.lit("a")), F.lit("")))
    assert got == ["a", "", "", ""]


ODD = ["", " ", "\x1c", "\x1c \n", "a", "A. B", " A.  B. \n", "\x1d A.\x1f B! 'C?' (D", "x y z. 1 2 3.\n\n“Q w e.” R", "É. Ü ß. 7-8 d'e’f.", "one.Two. Three ", *[" ".join(f"W{i} x{'.' * (i % 3 == 0)}" for i in range(n)) for n in (95, 97, 3200)]]


def test_counts_of_odd_texts(spark):
    """Sentences and words are counted as they are listed; the end of a text is that of the trimmed one."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, *ODD])], "i int, t string")
    f = tx.surface("t")
    least = [tx.has_words("t", k) == (tx.word_count("t") >= k) for k in range(5)]
    ends = F.regexp_replace(F.coalesce("t", F.lit("")), tx._EDGES, "").rlike(tx.TERMINAL)
    for r in df.select("i", "t", f["n_sentences"].alias("n"), F.size(tx.sentence_texts("t")).alias("m"), (f["ends_sentence"] == ends).alias("e"), F.array(*least).alias("w")).collect():
        assert r.n == r.m and r.e and all(r.w), r.i


def test_claims_carry_no_text(spark):
    """Joined sentences are cut from the text as its characters say; rows of claims hold neither the text nor the spans."""
    spans = {i: [(a, a + n) for a, n in ((0, 9), (1, 2), (40, 30), (45, 0), (len(t) - 3, 9)) if a >= 0] for i, t in enumerate(ODD)}
    df = spark.createDataFrame([(i, t, spans[i]) for i, t in enumerate(ODD)], "id int, t string, s array<struct<start:int,end:int>>")
    got = re_.labelled_claims(df, "id", "t", "s", min_words=0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "substr" not in plan[: plan.index("Generate")]  # above, the text would be searched for every claim
    rows = {i: [] for i in range(len(ODD))}
    for r in got.orderBy("id", "claim_index").collect():
        rows[r.id].append(r)
        assert r.claim == ODD[r.id][r.claim_start : r.claim_end] and r.label == any(s < r.claim_end and e > r.claim_start for s, e in spans[r.id])
    for i, t in enumerate(ODD):
        want = []
        for a, b in cut(t):
            if want and any(s < want[-1][1] and e > a and s < e for s, e in spans[i]):
                want[-1] = (want[-1][0], b)
            else:
                want.append((a, b))
        assert [(r.claim_start, r.claim_end) for r in rows[i]] == want
