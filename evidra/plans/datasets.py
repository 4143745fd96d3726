"""Queries of dataset builds with their audit, of labels joined after scoring, of stored metrics and of decisions out of fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import models as mo
from evidra.functions import text as tx
from evidra.functions.scalars import cosine
from evidra.operators import dataset as ds
from evidra.operators import frozen as fz
from evidra.operators import guard as gd
from evidra.operators import metrics as me
from evidra.operators import retrieval as re_
from evidra.operators import views as vw
from evidra.plans.queries import _CUBE, _TOKENS, cube, query
from evidra.sources import writers as wr
from evidra.sources.readers import table

#: The stand-in encoder and chunking of the build, stamped on each row.
STAMPS = {"retriever_model": "hashed-bag", "retriever_revision": "16", "chunking": "64/16"}
#: Fewest words of a claim.
MIN_WORDS = 3

_BAG = "list_transform(list_value('0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f'), lambda d: CAST(len(list_filter({t}, lambda w: substring(md5(w), 1, 1) = d)) AS DOUBLE))"
_SPLIT = "CASE WHEN conv_id % 10 < 8 THEN 'train' WHEN conv_id % 10 = 8 THEN 'validation' ELSE 'test' END"
_EMPTY_SQL = {"": "''", "_score": "NULL", "_source_index": "-1", "_window_index": "-1", "_token_start": "-1", "_token_end": "-1", "_sha256": "''"}


def dataset_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, candidates, rejected): assistant turns, windows of the other turns of their conversation, and assistant turns of too few words."""
    c = table(spark, sf_dir, "conversations").withColumn("turn_id", F.concat_ws(":", "conv_id", "turn"))
    of = F.pmod("conv_id", F.lit(10))
    split = F.when(of < 8, "train").when(of == 8, "validation").otherwise("test")
    a = c.where("role = 'assistant'").withColumn("t", tx.tokens(F.coalesce("text", F.lit(""))))
    short = F.size("t") < MIN_WORDS
    label = F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(5)) == 0
    claims = a.where(~short).select(F.col("turn_id").alias("example_id"), F.col("conv_id").alias("source_id"), split.alias("split"), F.col("text").alias("claim"), label.alias("label"), mo.hashed_bag(F.col("t")).alias("vector"))
    others = c.where("role <> 'assistant'").select("conv_id", "turn", "turn_id", "text")
    windows = re_.chunks(others, "turn_id", "text").withColumn("__id", F.split("turn_id", ":"))
    place = (F.col("__id")[0].cast("long").alias("source_id"), F.col("__id")[1].cast("int").alias("source_index"))
    candidates = windows.select(*place, "window_index", "token_start", "token_end", "text", "sha256", "chunk_key", mo.hashed_bag(F.split("text", " ")).alias("vector"))
    return claims, candidates, a.where(short).select(F.col("turn_id").alias("example_id"), F.lit("short_claim").alias("reason"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, {_TOKENS} AS t FROM conversations WHERE text IS NOT NULL AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
           a AS (SELECT *, {_BAG.format(t='t')} AS u FROM t WHERE role = 'assistant' AND len(t) >= {MIN_WORDS}),
           w AS (SELECT conv_id, turn, t, unnest(range(0, CAST(greatest(0, ceil((len(t) - 64) / 48.0)) AS BIGINT) + 1)) AS i FROM t WHERE role <> 'assistant'),
           c AS (SELECT conv_id, CAST(turn AS INTEGER) AS source_index, CAST(i AS INTEGER) AS window_index, CAST(i * 48 AS INTEGER) AS token_start, CAST(least(i * 48 + 64, len(t)) AS INTEGER) AS token_end, list_slice(t, i * 48 + 1, i * 48 + 64) AS ct FROM w),
           v AS (SELECT *, {_BAG.format(t='ct')} AS v, array_to_string(ct, ' ') AS text FROM c),
           n AS (SELECT conv_id, count(*) AS num_candidate_chunks FROM v GROUP BY conv_id),
           p AS (SELECT a.conv_id, a.turn, v.source_index, v.window_index, v.token_start, v.token_end, v.text, sha256(v.text) AS sha256,
                        coalesce(list_dot_product(u, v) / nullif(sqrt(list_dot_product(u, u) * list_dot_product(v, v)), 0), 0) AS score FROM a JOIN v ON a.conv_id = v.conv_id),
           r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, source_index, window_index) AS rank FROM p),
           s AS (SELECT conv_id, turn, CAST(count(*) FILTER (rank <= 4) AS INTEGER) AS n_valid, {', '.join(f"max({name}) FILTER (rank = {i}) AS f{i}{suffix}" for i in range(1, 5) for suffix, (name, _) in ds.FIELDS.items())} FROM r GROUP BY conv_id, turn)
           SELECT concat(a.conv_id, ':', a.turn) AS example_id, a.conv_id AS source_id, {_SPLIT.replace('conv_id', 'a.conv_id')} AS split, a.text AS claim, (a.conv_id * 7 + a.turn * 3) % 5 = 0 AS label, num_candidate_chunks, n_valid,
                  {', '.join(f"round(f{i}_score, 8) AS chunk_{i}_score" if suffix == '_score' else f"coalesce(f{i}{suffix}, {_EMPTY_SQL[suffix]}) AS chunk_{i}{suffix}" for i in range(1, 5) for suffix in ds.FIELDS)},
                  {', '.join(f"'{v}' AS {k}" for k, v in STAMPS.items())}
           FROM a JOIN n ON a.conv_id = n.conv_id JOIN s ON a.conv_id = s.conv_id AND a.turn = s.turn""")
def top4_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset of assistant turns and their four best windows, built with its audit into a new folder of spark.checkpoint.dir and read from there."""
    claims, candidates, short = dataset_inputs(spark, sf_dir)
    rows, none = ds.slot_rows(claims, candidates, "source_id", cosine, **STAMPS)
    path = wr.scratch(spark, "dataset")
    ds.build(rows, short.unionByName(none), path, {"sf_dir": sf_dir, "min_words": MIN_WORDS} | STAMPS)
    got = spark.read.schema(rows.schema).parquet(f"{path}/dataset")
    got = got.withColumn("n_valid", F.size(F.filter("evidence_mask", lambda x: x))).drop("evidence_mask")
    return got.withColumns({f"chunk_{i}_score": F.round(f"chunk_{i}_score", 8) for i in range(1, 5)})


@query("""SELECT d.doc_id, d.source, round(CAST(d.n_chars AS DOUBLE) / (d.n_chars + 500.0::DOUBLE), 8) AS score, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def labels_after_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a label, scored by a plan that must not read it; their labels join once the scores stand and the keys of both sides are equal."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    scores = d.select("doc_id", "source", F.round(F.col("n_chars") / (F.col("n_chars") + 500.0), 8).alias("score"))
    return gd.label_after(scores, labels, "doc_id", "quality").withColumnRenamed("quality", "label")


# -- out of fold --------------------------------------------------------------------------------------------------------------

#: Outer folds by source. The fold after the test fold is its validation part.
FOLDS = 5
_FOLD_SQL = f"CAST(floor(((CAST(substring(source, 4) AS BIGINT) * 48271 + 11) % 2147483647) / 7.0) AS BIGINT) % {FOLDS}"


@query(f"""WITH {_CUBE}, e AS (SELECT doc_id, CAST({_FOLD_SQL} AS INTEGER) AS fold, max(label) AS label, avg(score) AS score FROM cb WHERE condition = 'base' GROUP BY doc_id, source),
           v AS (SELECT (fold + {FOLDS - 1}) % {FOLDS} AS fold, label, score FROM e),
           th AS (SELECT DISTINCT fold, score AS t FROM v UNION SELECT DISTINCT fold, x.t FROM v, (SELECT unnest([0.0::DOUBLE, 1.0::DOUBLE, 1.0000000000000002::DOUBLE]) AS t) x),
           pt AS (SELECT v.fold, t, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp, count(*) FILTER (score < t AND label = 0) AS tn, count(*) FILTER (score < t AND label = 1) AS fn FROM v JOIN th ON v.fold = th.fold GROUP BY 1, 2),
           pm AS (SELECT fold, t, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall, coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0) AS fpr FROM pt),
           f AS (SELECT fold, t FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, t DESC) AS r FROM pm) WHERE r = 1),
           o AS (SELECT fold, t FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY recall DESC, fpr ASC, t DESC) AS r FROM pm WHERE fpr <= 0.1 + 1e-12) WHERE r = 1)
           SELECT doc_id, e.fold, CAST(label AS INTEGER) AS label, round(score, 8) AS score, f.t AS threshold_max_f1, o.t AS threshold_operational, score >= f.t AS prediction_max_f1, score >= o.t AS prediction_operational
           FROM e JOIN f ON e.fold = f.fold JOIN o ON e.fold = o.fold""")
def out_of_fold_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document decided once, by thresholds of its outer fold's validation part, over scores averaged across seeds."""
    e = cube(spark, sf_dir).where("condition = 'base'").groupBy("doc_id", "source").agg(F.max("label").alias("label"), F.avg("score").alias("score"))
    e = e.withColumn("fold", vw.bucket(F.substring("source", 4, 10).cast("long"), FOLDS).cast("int"))
    validation = e.withColumn("fold", F.pmod(F.col("fold") + FOLDS - 1, F.lit(FOLDS)))
    got = fz.out_of_fold(validation, e, table(spark, sf_dir, "labels").select("doc_id"), "fold", "doc_id", "label", "score")
    return got.withColumn("score", F.round("score", 8)).withColumn("label", F.col("label").cast("int"))


# -- stored metrics -------------------------------------------------------------------------------------------------------------

#: Metrics held against their stored values, with the tolerance of each.
TOLERANCES = {"precision": 1e-12, "recall": 1e-12, "f1": 1e-6}


def _rates_of(where: str) -> str:
    return f"""SELECT condition, CAST(seed AS INTEGER) AS seed, source, coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall, coalesce(CAST(2 * tp AS DOUBLE) / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1
        FROM (SELECT condition, seed, source, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM cb WHERE {where} GROUP BY 1, 2, 3)"""


@query(f"""WITH {_CUBE}, a AS ({_rates_of("doc_id % 11 <> 0")}), b AS ({_rates_of("true")}),
           la AS (UNPIVOT a ON precision, recall, f1 INTO NAME metric VALUE x), lb AS (UNPIVOT b ON precision, recall, f1 INTO NAME metric VALUE x)
           SELECT lb.condition, lb.seed, lb.source, lb.metric, round(la.x, 8) AS observed, round(lb.x, 8) AS stored,
                  CASE WHEN la.x IS NULL THEN 'extra' WHEN abs(la.x - lb.x) > CASE WHEN lb.metric = 'f1' THEN 1e-6 ELSE 1e-12 END THEN 'differs' END AS fault
           FROM lb LEFT JOIN la ON la.condition = lb.condition AND la.seed = lb.seed AND la.source = lb.source AND la.metric = lb.metric""")
def stored_metric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by run and source, computed anew after a change of the population (every eleventh document was withdrawn), against the stored ones of all:
    each cell with its fault, if any."""
    c = cube(spark, sf_dir)
    at = [me.confusion(x, ["condition", "seed", "source"], "label", F.col("score") >= 0.5) for x in (c.where("doc_id % 11 <> 0"), c)]
    stored = wr.settled(at[1], "stored-metrics")
    got = fz.cells(at[0], stored, ["condition", "seed", "source"], TOLERANCES)
    return got.withColumns({k: F.round(k, 8) for k in ("observed", "stored")})
