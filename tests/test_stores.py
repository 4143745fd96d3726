"""Exact parts, keyed caches and resumable scoring, with faults planted."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.sources import caches as ca
from evidra.sources import parts as pt
from evidra.streaming import resume as rs

ROWS = "id long, t string, x long"


def table(spark, n, cut):
    return spark.range(n).repartition(cut).selectExpr("id", "concat('é\n', id) AS t", "if(id % 3 = 0, null, id) AS x")


def files(path):
    return {f: (path / f).read_bytes() for f in sorted(os.listdir(path)) if not f.startswith(".")}


@pytest.mark.parametrize("zipped", [False, True])
def test_parts_are_exact_and_stable(spark, tmp_path, zipped):
    a, b = tmp_path / "a", tmp_path / "b"
    m = pt.write_parts(table(spark, 7250, 5), str(a), ["id"], 100, zipped)
    assert (m["rows"], m["parts"]) == (7250, 73)
    pt.write_parts(table(spark, 7250, 2), str(b), ["id"], 100, zipped)
    assert files(a) == files(b)
    got = pt.read_parts(spark, str(a), ROWS).collect()
    assert {r.id: (r.t, r.x, r.part) for r in got} == {i: (f"é\n{i}", None if i % 3 == 0 else i, i // 100) for i in range(7250)} and len(got) == 7250


def test_half_a_run_goes_on(spark, tmp_path):
    a = tmp_path / "a"
    pt.write_parts(table(spark, 1000, 3), str(a), ["id"], 100)
    whole = files(a)
    for f in ("_manifest.json", "part-000003.jsonl", "part-000009.jsonl", "digests-000000.json"):
        (a / f).unlink()
    with pytest.raises(ValueError, match="not complete"):
        pt.read_parts(spark, str(a), ROWS)
    kept = (a / "part-000001.jsonl").stat().st_mtime_ns
    pt.write_parts(table(spark, 1000, 4), str(a), ["id"], 100)
    assert files(a) == whole and (a / "part-000001.jsonl").stat().st_mtime_ns == kept


def test_parts_of_other_runs_are_refused(spark, tmp_path):
    a = tmp_path / "a"
    pt.write_parts(table(spark, 300, 3), str(a), ["id"], 100)
    with pytest.raises(ValueError, match="another signature"):
        pt.write_parts(table(spark, 300, 3), str(a), ["id"], 50)
    (a / "_manifest.json").unlink()
    with pytest.raises(Exception, match="other rows"):
        pt.write_parts(table(spark, 300, 3).withColumn("t", F.lit("new")), str(a), ["id"], 100)
    assert not (a / "_manifest.json").exists()


def test_a_changed_or_lost_part_is_found(spark, tmp_path):
    for name, harm in (("a", lambda p: p.write_text("{}\n")), ("b", lambda p: p.unlink())):
        pt.write_parts(table(spark, 300, 3), str(tmp_path / name), ["id"], 100)
        harm(tmp_path / name / "part-000001.jsonl")
        with pytest.raises(ValueError, match="1 parts changed or lost"):
            pt.read_parts(spark, str(tmp_path / name), ROWS)


def test_an_empty_table_has_no_part(spark, tmp_path):
    m = pt.write_parts(table(spark, 0, 1), str(tmp_path / "a"), ["id"], 100)
    assert (m["rows"], m["parts"]) == (0, 0) and pt.read_parts(spark, str(tmp_path / "a"), ROWS).count() == 0


def vectors(spark, n=200, harm=None):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(ca.content_key("m", str(i)), [float(x) for x in r]) for i, r in enumerate(v)]
    return rows, spark.createDataFrame([harm(i, k, r) if harm else (k, r) for i, (k, r) in enumerate(rows)], "key string, vector array<float>")


def test_cache_opens_only_asked_buckets(spark, tmp_path):
    p = tmp_path / "c"
    rows, df = vectors(spark)
    ca.write_cache(df, str(p), "key", "vector", 8, "s1", buckets=16)
    got = {r.key: r.vector for r in ca.read_cache(spark, str(p), "s1").collect()}
    assert got.keys() == dict(rows).keys() and all(np.allclose(got[k], v, atol=1e-6) for k, v in rows)
    ask = [rows[0][0], rows[1][0]]
    used = {f"bucket-{ca.bucket_of(k, 16):05d}.parquet" for k in ask}
    for f in p.iterdir():
        if f.name.startswith("bucket-") and f.name not in used:
            f.write_bytes(b"not parquet")
    got = ca.read_cache(spark, str(p), keys=[*ask, "unknown"] if ca.bucket_of("unknown", 16) in {ca.bucket_of(k, 16) for k in ask} else ask)
    assert {r.key for r in got.collect()} == set(ask)
    assert got.where(F.col("key") == ask[0]).count() == 1 and got.count() == 2
    asked = spark.createDataFrame([(k, i) for i, k in enumerate([*ask, ask[0], None])], "id string, n int")
    found = ca.lookup(asked, str(p), "id").collect()
    assert sorted((r.n, r.vector is None) for r in found) == [(0, False), (1, False), (2, False), (3, True)]
    with pytest.raises(Exception, match="(?i)parquet"):
        ca.read_cache(spark, str(p)).collect()


def test_jvm_and_python_agree_on_buckets(spark):
    ks = ["", "a", "é", "x" * 1000, "日本"]
    got = spark.createDataFrame([(k,) for k in ks], "key string").select("key", ca.bucket("key", 7).alias("b")).collect()
    assert {r.key: r.b for r in got} == {k: ca.bucket_of(k, 7) for k in ks}


@pytest.mark.parametrize(
    ("harm", "why"),
    [
        (lambda i, k, v: (k, [x * 1.01 for x in v] if i == 5 else v), "norm 1"),
        (lambda i, k, v: (k, [float("nan")] + v[1:] if i == 5 else v), "finite"),
        (lambda i, k, v: (k, v[:7] if i == 5 else v), "8 numbers"),
        (lambda i, k, v: (k, None if i == 5 else v), "8 numbers"),
        (lambda i, k, v: ("same" if i in (5, 90) else k, v), "repeats"),
        (lambda i, k, v: (None if i == 5 else k, v), "null"),
    ],
)
def test_bad_vectors_are_never_cached(spark, tmp_path, harm, why):
    with pytest.raises(Exception, match=why):
        ca.write_cache(vectors(spark, harm=harm)[1], str(tmp_path / "c"), "key", "vector", 8, "s", buckets=4)
    with pytest.raises(Exception, match="no complete cache"):
        ca.read_cache(spark, str(tmp_path / "c")).collect()


def test_a_bad_norm_on_disk_is_an_error(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    p = tmp_path / "c"
    ca.write_cache(vectors(spark)[1], str(p), "key", "vector", 8, "s", buckets=2)
    t = pq.read_table(p / "bucket-00001.parquet")
    worse = pa.FixedSizeListArray.from_arrays(pa.compute.multiply(t["vector"].combine_chunks().flatten(), pa.scalar(1.01, pa.float32())), 8)
    pq.write_table(pa.table({"key": t["key"], "vector": worse}), p / "bucket-00001.parquet")
    with pytest.raises(Exception, match="norm 1"):
        ca.read_cache(spark, str(p)).collect()
    with pytest.raises(Exception, match="signature"):
        ca.read_cache(spark, str(p), "other").collect()
    with pytest.raises(ValueError, match="another signature"):
        ca.write_cache(vectors(spark)[1], str(p), "key", "vector", 8, "t", buckets=2)


def source(path, name, ids):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(json.dumps({"id": i}) + "\n" for i in ids))


def test_scores_resume_in_mid_batch(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    die = tmp_path / "die"

    def score(d):
        def fail(i: int) -> int:
            if die.exists() and i == 5:
                raise RuntimeError("executor lost")
            return i * 2

        return d.withColumn("s", F.udf(fail, "long")("id"))

    def run(**config):
        rs.score_available(spark, str(src), "id long", score, out, ck, "id", config=config)

    source(src, "1.json", [1, 2, 2, None])
    run(model="a")
    source(src, "2.json", [2, 3, 4, 5])
    die.touch()
    with pytest.raises(Exception, match="executor lost"):
        run(model="a")
    with pytest.raises(ValueError, match="belongs to fingerprint"):
        run(model="b")
    die.unlink()
    run(model="a")
    run(model="a")
    assert sorted((r.id, r.s) for r in spark.read.parquet(out).collect()) == [(i, 2 * i) for i in range(1, 6)]
    ids = spark.range(1, 6)
    with pytest.raises(ValueError, match="'missing': 1"):
        rs.finish(spark, spark.range(1, 7), out, str(tmp_path / "f"), "id", {"model": "a"})
    with pytest.raises(ValueError, match="'unexpected': 1"):
        rs.finish(spark, spark.range(1, 5), out, str(tmp_path / "f"), "id", {"model": "a"})
    with pytest.raises(ValueError, match="'foreign': 5"):
        rs.finish(spark, ids, out, str(tmp_path / "f"), "id", {"model": "b"})
    assert rs.finish(spark, ids, out, str(tmp_path / "f"), "id", {"model": "a"}, rows=2)["parts"] == 3
    lines = [json.loads(x)["id"] for i in range(3) for x in (tmp_path / "f" / f"part-{i:06d}.jsonl").read_text().splitlines()]
    assert lines == [1, 2, 3, 4, 5]
