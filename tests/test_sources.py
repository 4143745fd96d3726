from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evidra.operators import cost, quality, views
from evidra.operators import retrieval as rt
from evidra.sources import readers as rd
from evidra.sources import writers as wr
from evidra.streaming.resume import score_available

GOOD = {"opiniao": "ok", "chunks_proximos": ["a", "b", "c", "d"], "verificacao_alucinacao": {"verificacao_manual": True}}
BAD = {"opiniao": "x", "chunks_proximos": ["a", " ", "c"], "verificacao_alucinacao": {"verificacao_manual": None}}


def test_nested_hearing(spark, tmp_path):
    p = tmp_path / "h.jsonl"
    p.write_text(json.dumps({"id": 7, "metadados_extraidos": {"assunto": "s", "envolvidos": [{"nome": "n", "cargo": "c", "opinioes": [GOOD, BAD]}]}}) + "\n\n")
    ok, rejected = rd.normalised(rd.jsonl(spark, str(p), rd.HEARING))
    assert [(r.sample_id, r.label, r.chunk_count) for r in ok.collect()] == [("7:0:0", 1, 4)]
    assert [r.rejection_reason for r in rejected.collect()] == ["missing_label|wrong_chunk_count|blank_chunk"]


def test_bad_json_fails(spark, tmp_path):
    p = tmp_path / "b.jsonl"
    p.write_text('{"id": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        rd.jsonl(spark, str(p), "id long").collect()


def test_contracts(spark):
    df = spark.createDataFrame([("a", "h", 1, 0.5), ("a", "h", 0, 2.0)], "example_id string, hearing_id string, label int, score double")
    with pytest.raises(ValueError, match="repeat"):
        rd.require_unique(df, ["example_id"])
    with pytest.raises(ValueError, match="bad scores"):
        rd.predictions(df, "score")
    with pytest.raises(ValueError, match="lacks"):
        rd.require_columns(df, ["nope"])
    one = df.limit(1)
    assert rd.paired(rd.conditions({("x", 0): one, ("y", 0): one})).count() == 2
    with pytest.raises(ValueError, match="do not pair"):
        rd.paired(rd.conditions({("x", 0): one, ("y", 0): one.where("false")}).unionAll(rd.conditions({("y", 0): one.withColumn("example_id", F.lit("z"))})))


def test_run_is_whole_and_resumes(spark, tmp_path):
    df = spark.range(5)
    run = wr.write_run({"t": df}, str(tmp_path), {"k": 1})
    assert wr.write_run({"t": spark.range(9)}, str(tmp_path), {"k": 1}) == run
    assert wr.read_run(spark, run)["t"].count() == 5
    spark.range(3).write.mode("append").parquet(f"{run}/t")
    with pytest.raises(ValueError, match="changed"):
        wr.read_run(spark, run)
    with pytest.raises(FileExistsError):
        wr.write_staged(df, run)


def test_append_and_latest(spark, tmp_path):
    p = str(tmp_path / "cache")
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id int, v string")
    assert wr.append_missing(a, p, "id") == 2 and wr.append_missing(a, p, "id") == 0
    v = spark.createDataFrame([(1, 1, "old"), (1, 2, "new")], "id int, n int, v string")
    assert wr.latest(v, "id", "n").first().v == "new"


def test_csv_and_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x,"y"', ["p", "q"])], "split string, t string, l array<string>")
    wr.csv_with_json(df, str(tmp_path / "c"))
    assert rd.csv(spark, str(tmp_path / "c"), "split string, t string, l string", {"l": "array<string>"}).first() == df.first()
    wr.jsonl_by(df, str(tmp_path / "j"), "split", gzip=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_stream_scores_once(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "1.json").write_text('{"id": 1}\n{"id": 2}\n')
    args = (spark, str(src), "id long", lambda d: d.withColumn("s", F.col("id") * 2), str(tmp_path / "out"), str(tmp_path / "ck"), "id")
    score_available(*args)
    (src / "2.json").write_text('{"id": 2}\n{"id": 3}\n')
    score_available(*args)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_dedup_policy(spark):
    rows = [("s1", "same", 1, "r1"), ("s1", "same", 1, "r2"), ("s1", "conf", 1, "r3"), ("s1", "conf", 0, "r4"), ("s1", "conf", 1, "r5"), ("s2", "same", 0, "r6")]
    df = spark.createDataFrame(rows, "source string, claim string, label int, response string")
    g = views.duplicate_groups(df, "source", "claim", "label")
    d = views.decisions(g, views.input_differences(df, ["source", "claim"], "response", [], []), ["source", "claim"])
    assert {(r.source, r.claim): r.decision for r in d.collect()} == {("s1", "same"): "collapse", ("s1", "conf"): "drop_conflict", ("s2", "same"): "singleton"}
    kept = views.representatives(df, ["source", "claim"], [F.col("response")])
    assert {r.response for r in kept.collect()} == {"r1", "r3", "r6"}


def test_folds_and_splits_keep_groups(spark):
    df = spark.createDataFrame([(f"h{i // 2}", (i // 2 + i % 2) % 2) for i in range(40)], "g string, label int")
    folds = views.k_folds(df, "g", "label").collect()
    assert len({r.group for r in folds}) == 20 and {r.fold for r in folds} == set(range(5))
    split = views.grouped_split(df, "g", "label", 0.2).collect()
    assert len(split) == 20 and 1 <= sum(r.partition == "validation" for r in split) <= 8


def test_gate_and_strict_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, f string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id int, f string")
    assert quality.alignment_gate(a, b, "id", ["f"]).first().asDict() == {"only_source": 1, "only_target": 1, "f_mismatch": 1}
    with pytest.raises(ValueError, match="do not pair"):
        quality.strict_join(a, b, "id", ["f"])
    assert quality.strict_join(a, a, "id", ["f"]).count() == 2


def test_ties_share_a_bucket(spark):
    df = spark.createDataFrame([(0.0,)] * 10 + [(float(i),) for i in range(1, 7)], "v double")
    sizes = sorted(r["count"] for r in quality.quantile_buckets(df, "v", 4).groupBy("bucket").count().collect())
    assert sizes == [4, 12]


def test_decimal_costs_are_exact(spark):
    t = spark.createDataFrame([("p", "m", 123456789, 1)], "prompt string, model string, input_tokens long, output_tokens long")
    p = spark.createDataFrame([("m", "0.9695200000000001", "3.0")], "model string, i string, o string").select("model", F.col("i").cast("decimal(18,13)").alias("input_price"), F.col("o").cast("decimal(18,13)").alias("output_price"))
    r = cost.costs(t, p, ["prompt"]).first()
    assert str(r.output_cost) == "0.000003000000000000"


def test_chunks_stop_at_the_end(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(100)))), (2, "a b"), (3, " ")], "id int, t string")
    got = [(r.id, r.window_index, r.token_start, r.token_end) for r in rt.chunks(df, "id", "t", 64, 16).orderBy("id", "window_index").collect()]
    assert got == [(1, 0, 0, 64), (1, 1, 48, 100), (2, 0, 0, 2)]
