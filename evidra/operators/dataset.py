"""Claim datasets with fixed evidence slots: their rows, their audit, and a build that leaves a complete, checked folder or nothing."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from evidra.functions import text as tx
from evidra.functions.scalars import dot, jaccard
from evidra.operators.retrieval import SLOTS
from evidra.sources import writers as wr

#: Fields of a slot as suffixes of chunk_i, the candidate's column, and what an empty slot holds.
FIELDS = {
    "": ("text", ""),
    "_score": ("score", None),
    "_source_index": ("source_index", -1),
    "_window_index": ("window_index", -1),
    "_token_start": ("token_start", -1),
    "_token_end": ("token_end", -1),
    "_sha256": ("sha256", ""),
}
#: What decides between candidates of equal score, after it.
TIES = ["source_index", "window_index", "chunk_key"]
#: Slots whose word sets are at least so similar count as near duplicates; a score may exceed the one before it by so little.
NEAR, SLACK = 0.9, 1e-7


def slot_rows(claims: DataFrame, candidates: DataFrame, group: str, score: Callable[[str, str], Column] = dot, k: int = SLOTS, **stamps: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): claims (example_id, group, vector, anything else) with the k best candidates (group, chunk_key, source_index, window_index,
    token_start, token_end, text, sha256, vector) of their own group as k times seven columns, num_candidate_chunks, evidence_mask and the stamps as constant
    columns; and the claims whose group has no candidate or is null, with the reason. Ties go by place, then key. A claim id that occurs twice stays twice,
    for the audit to find. Pairs carry no text: it is joined to the k that are left."""
    sized = candidates.groupBy(group).agg(F.count("*").alias("num_candidate_chunks"))
    known = claims.join(sized, group, "left")
    c = candidates.select(F.col(group).alias("__g"), *TIES, F.col("vector").alias("__v"))
    pairs = claims.select("example_id", F.col(group).alias("__g"), F.col("vector").alias("__u")).join(c, "__g").select("example_id", "__g", *TIES, score("__u", "__v").alias("score"))
    best = Window.partitionBy("example_id").orderBy(F.desc("score"), *TIES)
    top = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    texts = candidates.select(F.col(group).alias("__g"), "chunk_key", "token_start", "token_end", "text", "sha256")
    names = [n for n, _ in FIELDS.values()]
    slots = top.join(texts, ["__g", "chunk_key"]).groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("rank", *names))).alias("__slots"))
    wide = known.where("num_candidate_chunks IS NOT NULL").join(slots, "example_id", "left")
    cols = [F.coalesce(F.get("__slots", F.lit(i))[name], F.lit(empty)).alias(f"chunk_{i + 1}{suffix}") for i in range(k) for suffix, (name, empty) in FIELDS.items()]
    mask = F.array(*[F.get("__slots", F.lit(i)).isNotNull() for i in range(k)]).alias("evidence_mask")
    keep = [x for x in claims.columns if x != "vector"]
    rows = wide.select(*keep, "num_candidate_chunks", *cols, mask, *[F.lit(v).alias(n) for n, v in stamps.items()])
    return rows, known.where("num_candidate_chunks IS NULL").select("example_id", F.lit("no_candidate_chunks").alias("reason"))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def row_faults(k: int = SLOTS) -> dict[str, Column]:
    """Faults that one row shows by itself. Nulls in the mask, and in text or place of an empty slot, are faults, too."""
    scores = F.array_compact(F.array(*[F.col(f"chunk_{i}_score") for i in range(1, k + 1)]))
    valid = [F.get("evidence_mask", F.lit(i)) for i in range(k)]
    return {
        "mask_length": F.coalesce(F.size("evidence_mask") != k, F.lit(True)),
        "score_order": _any([F.coalesce(F.get(scores, F.lit(i)) < F.get(scores, F.lit(i + 1)) - SLACK, F.lit(False)) for i in range(k - 1)]),
        "mask_text": _any([F.coalesce(v != (F.col(f"chunk_{i}") != ""), F.lit(True)) for i, v in enumerate(valid, 1)]),
        "mask_index": _any([F.coalesce(~v & F.coalesce(F.col(f"chunk_{i}_source_index") != -1, F.lit(True)), F.lit(False)) for i, v in enumerate(valid, 1)]),
    }


def _spread(name: str, x: Column) -> list[Column]:
    return [F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max"), F.avg(x).alias(f"{name}_mean")]


def counters(k: int = SLOTS) -> list[Column]:
    """What is counted while the rows are written; __valid are the filled slots, __words the word sets of their texts."""
    v = F.col("__valid")
    last = F.size(v) - 1
    repeats = {f: F.size(F.array_distinct(v[f])) < F.size(v) for f in ("text", "source_index")}
    near = _any([F.coalesce((F.size(F.get("__words", F.lit(a))) > 0) & (jaccard(F.get("__words", F.lit(a)), F.get("__words", F.lit(b))) >= NEAR), F.lit(False)) for a, b in combinations(range(k), 2)])
    first_score, last_score = F.get(v, F.lit(0))["score"], F.get(v, last)["score"]
    return [
        F.count("*").alias("examples"),
        F.count_if(F.col("label").cast("boolean")).alias("positives"),
        *_spread("claim_words", F.size(tx.tokens("claim"))),
        *_spread("candidates", F.col("num_candidate_chunks")),
        *_spread("top1_score", first_score),
        *_spread("last_score", last_score),
        F.avg(first_score - last_score).alias("top1_minus_last_mean"),
        F.avg(1 - F.size(v) / F.lit(k)).alias("masked_slot_rate"),
        F.avg(repeats["text"].cast("int")).alias("identical_rate"),
        F.avg(near.cast("int")).alias("near_duplicate_rate"),
        F.avg(repeats["source_index"].cast("int")).alias("same_source_index_rate"),
        *[F.count_if(t).alias(f"fault_{n}") for n, t in row_faults(k).items()],
    ]


def observed(rows: DataFrame, seen: Observation, k: int = SLOTS) -> DataFrame:
    """rows, whose counters are filled in by the action that reads them. They are the last step of a plan: Spark adds up the tasks of the last stage once
    each, also if executors are lost."""
    slots = F.array(*[F.struct(F.coalesce(F.get("evidence_mask", F.lit(i - 1)), F.lit(False)).alias("valid"), F.col(f"chunk_{i}").alias("text"), F.col(f"chunk_{i}_score").alias("score"), F.col(f"chunk_{i}_source_index").alias("source_index")) for i in range(1, k + 1)])
    x = rows.withColumn("__valid", F.filter(slots, lambda s: s["valid"]))
    x = x.withColumn("__words", F.transform("__valid", lambda s: F.array_remove(F.array_distinct(F.split(tx.normalise(F.lower(s["text"])), " ")), "")))
    return x.observe(seen, *counters(k)).select(*rows.columns)


def keyed_audit(rows: DataFrame) -> dict[str, int | dict]:
    """What only shows between rows: repeated ids, sources in several splits, claims that repeat in a source, with one label or with two; counts by split
    and label. Each is an aggregate that folds before its shuffle."""
    ids = rows.groupBy("example_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("x")).first()["x"]
    s = rows.groupBy("source_id").agg((F.min("split") != F.max("split")).alias("both")).agg(F.count("*").alias("n"), F.count_if("both").alias("x")).first()
    c = rows.groupBy("source_id", F.sha2("claim", 256)).agg(F.count("*").alias("n"), (F.min("label") != F.max("label")).alias("both"))
    c = c.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("again"), F.count_if("both").alias("conflict")).first()
    by = {f"{r['split']}:{int(bool(r['label']))}": r["count"] for r in rows.groupBy("split", "label").count().collect()}
    return {"duplicate_example_id": ids, "unique_sources": s["n"], "split_source_overlap": s["x"], "duplicate_claims_within_source": c["again"], "conflicting_duplicate_claims": c["conflict"], "by_split_label": by}


def build(rows: DataFrame, rejected: DataFrame, path: str, config: dict, k: int = SLOTS) -> dict:
    """Write path/dataset, path/rejected and path/manifest.json, and return the audit. rows need example_id, source_id, split, claim and label besides the
    slots; rejected example_id and reason. Counters come with the write; the keyed audit reads key columns of what was written. A fault of any kind, an
    empty dataset, or rows that were written and not counted are a ValueError that names them all, and nothing stays behind. A complete folder of the same
    config is left as it is; of another config, it is an error."""
    spark, mark = rows.sparkSession, wr.signature(config)
    if wr.exists(spark, f"{path}/manifest.json"):
        m = json.loads(wr.read_text(spark, f"{path}/manifest.json"))
        if m["signature"] != mark:
            raise ValueError(f"{path} holds a build of another configuration")
        return m["audit"]
    with wr.staged(spark, path) as stage:
        seen = Observation("dataset")
        observed(rows, seen, k).write.parquet(f"{stage}/dataset")
        rejected.select("example_id", "reason").write.json(f"{stage}/rejected")
        written = spark.read.schema(rows.schema).parquet(f"{stage}/dataset")
        n = written.count()
        if not n:
            raise ValueError("dataset: no rows")
        audit = seen.get | keyed_audit(written)
        audit["rejected"] = {r["reason"]: r["count"] for r in spark.read.schema("example_id string, reason string").json(f"{stage}/rejected").groupBy("reason").count().collect()}
        faults = {x: audit[f"fault_{x}"] for x in row_faults(k)} | {x: audit[x] for x in ("duplicate_example_id", "split_source_overlap")} | {"not_counted": n - audit["examples"]}
        faults = {x: v for x, v in faults.items() if v}
        if faults:
            raise ValueError(f"dataset: {faults}")
        wr.write_text(spark, f"{stage}/manifest.json", json.dumps({"config": config, "signature": mark, "status": "complete", "audit": audit}, sort_keys=True))
    return audit
