from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evidra.functions import models
from evidra.operators import prompts as pr
from evidra.operators import report as rp
from evidra.sources import nested
from evidra.sources import readers as rd

VALID = {"opiniao": "op", "chunks_proximos": ["a", "b", "a", "c"], "verificacao_alucinacao": {"verificacao_manual": True}}
INVALID = {"opiniao": "op", "chunks_proximos": ["a", " "], "verificacao_alucinacao": {"verificacao_manual": False}}


@pytest.fixture
def hearings(spark, tmp_path):
    p = tmp_path / "h.jsonl"
    p.write_text("\n".join(json.dumps({"id": i, "metadados_extraidos": {"assunto": "s", "envolvidos": [{"nome": "n", "cargo": None, "opinioes": [VALID, INVALID]}]}}) for i in range(3)))
    return rd.jsonl(spark, str(p), rd.HEARING)


def test_translation_changes_only_valid_texts(spark, hearings):
    known = spark.createDataFrame([(t, f"pt:{t}") for t in ("op", "a", "b", "c")], "source string, target string")
    got = nested.translated(hearings, known)
    o = [x.asDict(True) for x in got.first().metadados_extraidos.envolvidos[0].opinioes]
    assert o[0]["opiniao"] == "pt:op" and o[0]["chunks_proximos"] == ["pt:a", "pt:b", "pt:a", "pt:c"] and {**o[1], "verificacao_alucinacao": json.loads(o[1]["verificacao_alucinacao"])} == INVALID
    assert nested.structure_mismatches(hearings, got).count() == 0
    broken = nested.mapped(got, lambda x: x.withField("chunks_proximos", F.slice(x["chunks_proximos"], 1, 1)))
    assert nested.structure_mismatches(hearings, broken).count() == 3
    with pytest.raises(Exception, match="no translation"):
        nested.translated(hearings, known.where("source <> 'b'")).collect()


def test_rewriting_loses_nothing(spark):
    """Fields that no schema names, at every level, come through; decisions are read from the same lines."""
    decision = {"alucinacao": True, "explicacao": "because", "trechos_para_basear_analise": ["t"]}
    verified = {"verificacao_manual": False, "prompt_2_m-a": decision, "prompt_1_m-b": {"alucinacao": False, "explicacao": "no"}, "note": [1, None]}
    whole = {"id": 7, "extra": {"k": [1.5, "é"]}, "metadados_extraidos": {"assunto": "s", "data": "d", "envolvidos": [{"nome": "n", "partido": "p", "opinioes": [VALID | {"verificacao_alucinacao": verified, "tom": "x"}, INVALID]}]}}
    lines = spark.createDataFrame([(json.dumps(whole, ensure_ascii=False),), ('{"id": 8}',), (None,)], "value string")
    known = spark.createDataFrame([(t, f"pt:{t}") for t in ("op", "a", "b", "c")], "source string, target string")
    got = [r.value for r in nested.translated_json(lines, known, rd.HEARING).collect()]
    want = json.loads(json.dumps(whole))
    want["metadados_extraidos"]["envolvidos"][0]["opinioes"][0] |= {"opiniao": "pt:op", "chunks_proximos": ["pt:a", "pt:b", "pt:a", "pt:c"]}
    assert sorted((json.loads(x) for x in got if x), key=lambda x: x["id"]) == [want, {"id": 8}] and None in got
    o = rd.opinions(lines.where("value IS NOT NULL").select(F.from_json("value", rd.HEARING).alias("h")).select("h.*"))
    assert [(r.sample_id, r.label) for r in o.collect()] == [("7:0:0", False), ("7:0:1", False)]
    made = {(r.model, r.prompt): (r.predicted, r.decision.explicacao) for r in pr.decisions(o.withColumnRenamed("sample_id", "example_id")).collect()}
    assert made == {("m-a", "prompt_2"): (True, "because"), ("m-b", "prompt_1"): (False, "no")}


def test_mask_audit(spark):
    cols = "id int, m array<boolean>, c1 string, c2 string"
    a = spark.createDataFrame([(1, [True, False], "x", "")], cols)
    b = spark.createDataFrame([(1, [True, False], " ", "new")], cols)
    assert nested.masked_mismatches(a, b, "id", "m", ["c1", "c2"]).first().asDict() == {"mask_mismatch": 0, "lost_slots": 1, "masked_slot_changes": 1}


def test_prompts_and_decisions(spark, tmp_path):
    (tmp_path / "prompt_1.txt").write_text("[System]\nsys\n[User]\n{TEXTO}|{OPINIAO}")
    e = spark.createDataFrame([("1:0:0", ["a", "b"], "o")], "example_id string, evidence array<string>, opinion string")
    assert pr.messages(e, pr.templates(spark, str(tmp_path))).first().user_message == "a\n\nb|o"
    (tmp_path / "prompt_2.txt").write_text("no markers")
    with pytest.raises(Exception, match="not a prompt template"):
        pr.templates(spark, str(tmp_path)).collect()
    v = spark.createDataFrame([("1:0:0", True, {"prompt_1_m-a": (True, 'q"é', None), "prompt_2_m-b": (False, "e", ["p"]), "verificacao_manual": None})], f"example_id string, label boolean, verification {pr.DECISIONS}")
    got = {r.model: r for r in pr.decisions(v).withColumn("out", pr.canonical_output(F.col("decision"), F.col("prompt"))).collect()}
    assert json.loads(got["m-a"].out) == {"alucinacao": True, "explicacao": 'q"é'} and got["m-a"].predicted
    assert got["m-b"].out == '{"alucinacao":false,"explicacao":"e","trechos_para_basear_analise":["p"]}'


def test_reports(spark):
    df = spark.createDataFrame([("a_b", 0.5), ("c|d", None)], "name string, value double")
    assert rp.markdown(df).splitlines()[2:] == ["| a_b | 0.5000 |", "| c\\|d |  |"]
    assert r"a\_b & 0.5000 \\" in rp.latex(df, "t")
    for write in (rp.markdown, lambda d, limit: rp.latex(d, "t", limit)):
        with pytest.raises(ValueError, match="more than 1 rows"):
            write(df, limit=1)
    s = spark.createDataFrame([("x", "y", "f1", 0.1, 0.2), ("x", "z", "f1", 0.1, 0.3)], "condition_a string, condition_b string, metric string, point_a double, point_b double")
    assert {(r.condition, r.value) for r in rp.points(s).collect()} == {("x", 0.1), ("y", 0.2), ("z", 0.3)}
    with pytest.raises(Exception, match="conflicting points"):
        rp.points(s.withColumn("condition_b", F.lit("x"))).collect()


def test_model_contracts(spark):
    df = spark.createDataFrame([("t", [0.2, 0.9, 0.5], [True, False, True]), (None, [0.1], [False])], "t string, s array<double>, m array<boolean>")
    enc = [r[0] for r in df.select(models.mock_encoder(8)("t")).collect()]
    assert abs(sum(x * x for x in enc[0]) - 1) < 1e-5 and enc[0] == df.select(models.mock_encoder(8)("t")).first()[0]
    assert [r[0] for r in df.select(models.max_entailment(F.col("s"), F.col("m"))).collect()] == [0.5, None]
    v = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [True, True])], "v array<array<double>>, m array<boolean>")
    assert v.select(models.masked_mean(F.col("v"), F.col("m"), 2)).first()[0] == [2.0, 3.0]
