"""Slot rows against a loop, the audit's counts, planted faults of each kind, and labels that must stay out of scoring."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import dataset as ds
from evidra.operators import guard as gd
from evidra.sources import writers as wr

CLAIM = "example_id string, source_id string, split string, claim string, label boolean, vector array<double>"
CHUNK = "source_id string, source_index int, window_index int, token_start int, token_end int, text string, sha256 string, chunk_key string, vector array<double>"
CLAIMS = [
    ("a:0", "s1", "train", "one two three", True, [1.0, 0.0]),
    ("a:1", "s1", "train", "one two three", False, [0.0, 1.0]),
    ("b:0", "s2", "test", "four words are here", False, [0.6, 0.8]),
    ("c:0", "s3", "test", "nothing to find", True, [1.0, 0.0]),
    ("d:0", None, "test", "no source", True, [1.0, 0.0]),
]
TEXTS = {"s1": [("x y z", 0, 0, [1.0, 0.0]), ("x y z", 0, 1, [1.0, 0.0]), ("p q", 1, 0, [0.5, 0.5]), ("r", 2, 0, [0.0, 1.0]), ("t", 3, 0, [0.0, 0.9])], "s2": [("only one", 0, 0, [1.0, 0.0])], "s4": [("of no claim", 0, 0, [1.0, 1.0])]}
CHUNKS = [(s, a, b, b * 2, b * 2 + 3, t, f"h{t}", f"{s}:{a}:{b}", v) for s, x in TEXTS.items() for t, a, b, v in x]


def made(spark, claims=CLAIMS, chunks=CHUNKS):
    return ds.slot_rows(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(chunks, CHUNK), "source_id", retriever_model="m", retriever_revision="r1")


def test_rows_equal_loop(spark):
    rows, rejected = made(spark)
    got = {r.example_id: r for r in rows.collect()}
    assert set(got) == {"a:0", "a:1", "b:0"}
    assert {tuple(r) for r in rejected.collect()} == {("c:0", "no_candidate_chunks"), ("d:0", "no_candidate_chunks")}
    for i, s, split, claim, label, u in CLAIMS[:3]:
        best = sorted(((-float(np.dot(u, c[8])), c[1], c[2], c[7], c) for c in CHUNKS if c[0] == s))[:4]
        r = got[i]
        assert (r.source_id, r.split, r.claim, r.label, r.retriever_model, r.retriever_revision) == (s, split, claim, label, "m", "r1")
        assert r.num_candidate_chunks == len(TEXTS[s]) and r.evidence_mask == [k < len(best) for k in range(4)]
        for k in range(4):
            want = (best[k][4][5], -best[k][0], *best[k][4][1:5], best[k][4][6]) if k < len(best) else ("", None, -1, -1, -1, -1, "")
            assert tuple(r[f"chunk_{k + 1}{f}"] for f in ds.FIELDS) == pytest.approx(want)
    assert len([c for c in rows.columns if c.startswith("chunk_")]) == 28


def test_audit_and_build(spark, tmp_path):
    path = f"{tmp_path}/run"
    audit = ds.build(*made(spark), path, {"v": 1})
    assert (audit["examples"], audit["positives"], audit["unique_sources"]) == (3, 1, 2)
    assert audit["rejected"] == {"no_candidate_chunks": 2} and audit["by_split_label"] == {"train:1": 1, "train:0": 1, "test:0": 1}
    assert (audit["duplicate_claims_within_source"], audit["conflicting_duplicate_claims"]) == (1, 1)
    assert audit["masked_slot_rate"] == pytest.approx(3 / 12)
    # the first row holds "x y z" twice, from one place; the second has it once among its four
    assert audit["identical_rate"] == audit["near_duplicate_rate"] == audit["same_source_index_rate"] == pytest.approx(1 / 3)
    assert (audit["claim_words_min"], audit["claim_words_max"], audit["candidates_max"]) == (3, 4, 5)
    assert audit["top1_score_max"] == 1.0 and audit["top1_score_min"] == pytest.approx(0.6)
    assert json.loads(wr.read_text(spark, f"{path}/manifest.json"))["status"] == "complete"
    assert ds.build(*made(spark), path, {"v": 1}) == json.loads(json.dumps(audit))
    with pytest.raises(ValueError, match="another configuration"):
        ds.build(*made(spark), path, {"v": 2})


PLANTED = {
    "mask_length": lambda r: r.withColumn("evidence_mask", F.slice("evidence_mask", 1, 3)),
    "score_order": lambda r: r.withColumn("chunk_1_score", F.when(F.col("example_id") == "a:0", -5.0).otherwise(F.col("chunk_1_score"))),
    "mask_text": lambda r: r.withColumn("chunk_2", F.when(F.col("example_id") == "b:0", "ghost").otherwise(F.col("chunk_2"))),
    "mask_index": lambda r: r.withColumn("chunk_4_source_index", F.when(F.col("example_id") == "b:0", 7).otherwise(F.col("chunk_4_source_index"))),
    "duplicate_example_id": lambda r: r.unionAll(r.where("example_id = 'b:0'")),
    "split_source_overlap": lambda r: r.withColumn("split", F.when(F.col("example_id") == "a:1", "test").otherwise(F.col("split"))),
}


@pytest.mark.parametrize("fault", PLANTED)
def test_planted_faults_abort(spark, tmp_path, fault):
    rows, rejected = made(spark)
    with pytest.raises(ValueError, match=fault) as e:
        ds.build(PLANTED[fault](rows), rejected, f"{tmp_path}/run", {})
    assert not [f for f in PLANTED if f != fault and f in str(e.value) and f != "mask_text"]
    assert os.listdir(tmp_path) == []


def test_score_slack(spark):
    """A rise within the slack is no fault, a null mask entry is one."""
    rows, _ = made(spark)
    near = rows.withColumn("chunk_2_score", F.col("chunk_1_score") + 5e-8)
    assert near.where(ds.row_faults()["score_order"]).count() == 0
    null = rows.withColumn("evidence_mask", F.array(F.lit(None).cast("boolean"), F.lit(True), F.lit(True), F.lit(True)))
    assert null.where(ds.row_faults()["mask_text"]).count() == 3


def test_empty_and_failing_builds_leave_nothing(spark, tmp_path):
    rows, rejected = made(spark, CLAIMS[3:])
    with pytest.raises(ValueError, match="no rows"):
        ds.build(rows, rejected, f"{tmp_path}/run", {})
    rows, rejected = made(spark)
    broken = rows.withColumn("claim", F.when(F.col("example_id") == "b:0", F.raise_error(F.lit("lost"))).otherwise(F.col("claim")))
    with pytest.raises(Exception, match="lost"):
        ds.build(broken, rejected, f"{tmp_path}/run", {})
    assert os.listdir(tmp_path) == []


# -- labels and scores ------------------------------------------------------------------------------------------------------


@pytest.fixture
def two(spark, tmp_path):
    spark.range(20).select("id", (F.col("id") * 3).alias("x"), F.lit("t").alias("text")).write.parquet(f"{tmp_path}/docs")
    spark.range(20).select("id", (F.col("id") % 2).cast("int").alias("label"), F.lit(1).alias("weight")).write.parquet(f"{tmp_path}/labels")
    return spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/labels")


def test_leaks_are_refused(spark, two):
    docs, labels = two
    j = docs.join(labels, "id")
    hidden = labels.select("id", F.col("label").alias("h")).cache()
    leaks = [
        j.select("id", "label"),
        j.select("id", F.col("label").alias("score")),
        j.withColumnRenamed("label", "z").select("id", (F.col("x") + F.col("z") * 0.1).alias("score")),
        docs.join(labels.where("label = 1").select("id"), "id").select("id", F.col("x").alias("score")),
        docs.join(labels.groupBy("label").agg(F.max("id").alias("id")), "id").select("id", "x"),
        docs.join(hidden, "id").select("id", F.col("h").alias("score")),
        docs.where(F.col("x") > spark.sql("SELECT 1").select(F.lit(0)).scalar()).join(hidden, "id").select("id", "h"),
    ]
    for leak in leaks:
        with pytest.raises(ValueError, match="reads"):
            gd.refuse_reads(leak, ["LABEL"])
    labels.createOrReplaceTempView("the_labels")
    docs.createOrReplaceTempView("the_docs")
    with pytest.raises(ValueError, match="reads"):
        gd.refuse_reads(spark.sql("SELECT id, x + (SELECT max(label) FROM the_labels) AS score FROM the_docs"), ["label"])
    hidden.unpersist()
    for fine in (docs.select("id", "x"), j.drop("label"), j.select("id", F.col("label").alias("z"), "x").drop("z"), docs.join(labels, "id", "left_semi")):
        assert gd.refuse_reads(fine, ["label"]) is fine


def test_labels_join_after_scores(spark, two):
    docs, labels = two
    scores = docs.select("id", (F.col("x") / 60).alias("score"))
    got = gd.label_after(scores, labels, "id", "label", rows=20, positives=10).collect()
    assert {(r.id, r.score, r.label) for r in got} == {(i, i * 3 / 60, i % 2) for i in range(20)}
    for bad_scores, bad_labels, what in [
        (scores.where("id > 0"), labels, "without a score"),
        (scores, labels.where("id > 0"), "without a label"),
        (scores.unionAll(scores.where("id = 3")), labels, "repeated"),
        (scores, labels.withColumn("label", F.when(F.col("id") == 4, 2).otherwise(F.col("label"))), "not 0 or 1"),
        (scores, labels.withColumn("label", F.when(F.col("id") == 4, F.lit(None)).otherwise(F.col("label"))), "not 0 or 1"),
    ]:
        with pytest.raises(ValueError, match=what):
            gd.label_after(bad_scores, bad_labels, "id", "label")
    with pytest.raises(ValueError, match="positives"):
        gd.label_after(scores, labels, "id", "label", positives=9)
