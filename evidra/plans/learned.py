"""Queries of pooling heads, of splits with exact sizes and of bootstraps by one stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import pooling as po
from evidra.operators import quality as qu
from evidra.operators import splits as sp
from evidra.operators import streams as st
from evidra.plans.queries import _SCORED, REPLICATES, query, rounded, scored
from evidra.sources.readers import table

#: Numbers of a vector in the driver's table; rows of the gated head's matrices.
WIDTH, ATTENTION = 64, 8
#: Fixed congruences of the heads' values: (multiplier of row, of column, offset, modulus, divisor), so that SQL can state them too.
_VALUES = {"tanh": (31, 17, 0, 97, 480), "gate": (13, 29, 5, 89, 440), "weigh": (7, 0, 3, 11, 5), "score": (0, 37, 11, 83, 83)}


def _value(name: str, k: np.ndarray, i: np.ndarray) -> np.ndarray:
    a, b, c, m, d = _VALUES[name]
    return ((k * a + i * b + c) % m - m // 2) / d


def _value_sql(name: str) -> str:
    a, b, c, m, d = _VALUES[name]
    return f"(CAST((k * {a} + i * {b} + {c}) % {m} - {m // 2} AS DOUBLE) / CAST({d} AS DOUBLE))"


def plain_heads() -> dict[str, po.Head]:
    """Mean, max and gated attention with values by rule."""
    k, i = np.arange(ATTENTION)[:, None], np.arange(WIDTH)[None, :]
    score = {"score": _value("score", k[:1], i)[0], "score_shift": np.zeros(1)}
    gated = {n: _value(n, k, i) for n in ("tanh", "gate")} | {f"{n}_shift": np.zeros(ATTENTION) for n in ("tanh", "gate")} | {"weigh": _value("weigh", k[:, 0], np.zeros(ATTENTION, int))}
    return {"mean": po.Head("mean", score), "max": po.Head("max", score), "gated_attention": po.Head("gated_attention", score | gated)}


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four vectors in a row are a bag; some slots are masked, never the first."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("bag"), F.pmod("vec_id", F.lit(4)).alias("slot"), "embedding", "vec_id")
    return po.bags(e, ["bag"], "slot", "embedding", (F.col("slot") == 0) | (F.pmod("vec_id", F.lit(7)) != 3), WIDTH)


_E = """e AS (SELECT vec_id // 4 AS bag, vec_id % 4 AS slot, j - 1 AS i, CAST(embedding[j] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS j FROM embeddings WHERE embedding IS NOT NULL AND (vec_id % 4 = 0 OR vec_id % 7 <> 3)))"""


@query(f"""WITH {_E}, ks AS (SELECT unnest(range({ATTENTION})) AS k),
           gk AS (SELECT bag, slot, k, sum({_value_sql('tanh')} * x) AS t, sum({_value_sql('gate')} * x) AS g FROM e, ks GROUP BY bag, slot, k),
           lg AS (SELECT bag, slot, sum((SELECT {_value_sql('weigh')} FROM (SELECT 0 AS i)) * tanh(t) / (1 + exp(-g))) AS l FROM gk GROUP BY bag, slot),
           ga AS (SELECT bag, slot, exp(l - max(l) OVER (PARTITION BY bag)) AS u FROM lg),
           mx AS (SELECT bag, i, max(x) AS x FROM e GROUP BY bag, i),
           mw AS (SELECT bag, slot, CAST(count(*) AS DOUBLE) / {WIDTH} AS w FROM (SELECT e.bag, e.i, min(e.slot) AS slot FROM e JOIN mx ON e.bag = mx.bag AND e.i = mx.i AND e.x = mx.x GROUP BY e.bag, e.i) GROUP BY bag, slot),
           w AS (SELECT bag, slot, 'mean' AS head, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY bag) AS w FROM (SELECT DISTINCT bag, slot FROM e)
                 UNION ALL SELECT bag, slot, 'gated_attention', u / sum(u) OVER (PARTITION BY bag) FROM ga UNION ALL SELECT bag, slot, 'max', w FROM mw),
           p AS (SELECT w.bag, w.head, e.i, sum(w.w * e.x) AS x FROM w JOIN e ON w.bag = e.bag AND w.slot = e.slot WHERE w.head <> 'max' GROUP BY w.bag, w.head, e.i UNION ALL SELECT bag, 'max', i, x FROM mx),
           s AS (SELECT bag, head, sum((SELECT {_value_sql('score')} FROM (SELECT 0 AS k)) * x) AS logit FROM p GROUP BY bag, head)
           SELECT s.bag, s.head, round(logit, 6) AS logit, {', '.join(f"round(coalesce(max(CASE WHEN slot = {j} THEN w END), 0), 6) AS weight_{j}" for j in range(4))}
           FROM s JOIN w ON s.bag = w.bag AND s.head = w.head GROUP BY s.bag, s.head, logit""")
def pooling_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and logits of mean, max and gated attention pooling over bags of four masked slots."""
    got = po.pool(_bags(spark, sf_dir), plain_heads(), ["bag"])
    out = got.select("bag", "head", "logit", *[F.get("weights", F.lit(j)).alias(f"weight_{j}") for j in range(4)])
    return rounded(out, "logit", *[f"weight_{j}" for j in range(4)], digits=6)


@query()
def set_attention_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set attention over the same bags: a block of attention among the slots, pooling by attention from one seed."""
    got = po.pool(_bags(spark, sf_dir), {"set_transformer": po.Head.drawn("set_transformer", WIDTH, seed=3, lanes=4)}, ["bag"])
    out = got.select("bag", "head", "logit", *[F.get("weights", F.lit(j)).alias(f"weight_{j}") for j in range(4)])
    return rounded(out, "logit", *[f"weight_{j}" for j in range(4)], digits=6)


# -- splits of exact sizes ----------------------------------------------------------------------------------------------

_TOXIC = "gp AS (SELECT CAST(substring(source, 4) AS BIGINT) AS grp, count(*) AS n, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE source IS NOT NULL GROUP BY 1)"
_P = "2147483647"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring("source", 4, 20).cast("long").alias("source_id"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")


@query(f"""WITH {_TOXIC}, tot AS (SELECT CAST(count(*) AS BIGINT) AS g, CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS p, CAST(count(*) FILTER (p > 0) AS BIGINT) AS g1, CAST(count(*) FILTER (p = 0) AS BIGINT) AS g0 FROM gp),
           sz AS (SELECT *, CASE WHEN greatest(2, ceil(CAST(0.2 AS DOUBLE) * g)) >= g THEN g - 2 ELSE CAST(greatest(2, ceil(CAST(0.2 AS DOUBLE) * g)) AS BIGINT) END AS size FROM tot),
           k AS (SELECT *, size * g1 // g + CASE WHEN size - size * g1 // g - size * g0 // g = 1 AND (size * g1) % g > (size * g0) % g THEN 1 ELSE 0 END AS k1 FROM sz),
           c AS (SELECT unnest(range({sp.CANDIDATES})) AS candidate),
           h AS (SELECT candidate, grp, gp.n, gp.p, gp.p > 0 AS pos, ((((grp * 48271 + candidate * 16807 + 11) % {_P}) * 69621 + 7) % {_P} * 39373 + 13) % {_P} AS h FROM gp, c),
           r AS (SELECT *, row_number() OVER (PARTITION BY candidate, pos ORDER BY h, grp) AS r FROM h),
           held AS (SELECT candidate, grp, r.n, r.p FROM r, k WHERE r <= CASE WHEN pos THEN k1 ELSE size - k1 END),
           o AS (SELECT candidate, list(grp ORDER BY grp) AS members, round(abs(CAST(count(*) AS DOUBLE) / any_value(k.g) - CAST(0.2 AS DOUBLE)) + abs(CAST(sum(held.n) AS DOUBLE) / any_value(k.n) - CAST(0.2 AS DOUBLE)) + 2 * abs(CAST(sum(held.p) AS DOUBLE) / CAST(sum(held.n) AS DOUBLE) - CAST(any_value(k.p) AS DOUBLE) / any_value(k.n)), 12) AS loss FROM held, k GROUP BY candidate),
           best AS (SELECT candidate FROM o ORDER BY loss, members, candidate LIMIT 1)
           SELECT gp.grp AS "group", CASE WHEN gp.grp IN (SELECT grp FROM held WHERE candidate = (SELECT candidate FROM best)) THEN 'validation' ELSE 'train' END AS partition, gp.n, gp.p FROM gp""")
def fixed_size_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources split by the best of 128 stratified draws of exactly a fifth of them."""
    return sp.fixed_group_split(_rows(spark, sf_dir), "source_id", "toxic", 0.2, strict=False)  # in large tables every source has a positive


@query()
def nested_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as train, validation and test of five outer folds."""
    return sp.nested_group_folds(scored(spark, sf_dir), "source", "label")


@query(f"""WITH {_SCORED}, f AS (SELECT unnest(range(5)) AS outer_fold) SELECT CAST(outer_fold AS INTEGER) AS outer_fold, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS p, CAST(count(DISTINCT source) AS BIGINT) AS groups, CAST(0 AS BIGINT) AS faults FROM sc, f GROUP BY outer_fold""")
def nested_fold_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each outer fold's roles hold every row once; groups with two roles or not in exactly one test part are counted as faults."""
    rows = scored(spark, sf_dir)
    got = sp.nested_group_folds(rows, "source", "label")
    faults = sp.fold_faults(got, rows, "source", 5).agg(F.count("*").alias("faults"))
    return got.groupBy("outer_fold").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.count_distinct("group").alias("groups")).crossJoin(F.broadcast(faults))


# -- bootstraps by one stream ---------------------------------------------------------------------------------------------


@query()
def stream_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems compared by a cluster bootstrap whose draws go on from metric to metric."""
    rows = scored(spark, sf_dir).withColumn("t", F.pmod(F.col("doc_id") * 6101 + 29, F.lit(1000)) / 1000.0)
    got = st.paired_cluster(rows, "source", "label", (F.col("s") >= 0.5, "s"), (F.col("t") >= 0.5, "t"), REPLICATES, 42)
    return rounded(got, *got.columns[1:])


@query()
def qcut_auprc_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision by quality quartile with an interval over groups; rows without a quality are left out first."""
    b = qu.quantile_buckets(scored(spark, sf_dir).where(F.col("n_chars").isNotNull()), "n_chars", 4)
    got = st.bucket_intervals(b, "bucket", "source", "label", "s", REPLICATES, 4242)
    return rounded(got, "value", "ci95_lower", "ci95_upper")
