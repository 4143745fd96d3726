"""Claim builds, splits, stored decisions and linkage over the driver's tables; registered with the other queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions import scalars as sc
from evidra.functions import text as tx
from evidra.operators import bootstrap as bs
from evidra.operators import metrics as me
from evidra.operators import prompts as pr
from evidra.operators import quality as qu
from evidra.operators import retrieval as re_
from evidra.operators import views as vw
from evidra.plans.queries import _DRAWS, _SCORED, RATES, _cells_sql, _claims_spans, _draws, _rates_sql, query, rounded, scored
from evidra.sources.readers import HEARING, opinions, table

_H = "(CAST(floor((({k} * 48271 + 11) % 2147483647) / 7.0) AS BIGINT) % 1000003)"


# -- stored decisions ---------------------------------------------------------------------------------------------------

#: Models and prompts of the stored decisions: the decision of prompt p by model m on document d is (d * (7 p + m)) mod 3 = 0.
MODELS, PROMPTS = ("model-a", "model-b"), (1, 2, 3)
_DECIDED = " UNION ALL ".join(f"SELECT '{m}' AS model, 'prompt_{p}' AS prompt, label, (doc_id * {7 * p + i}) % 3 = 0 AS predicted FROM sc WHERE n_chars > 0" for i, m in enumerate(MODELS) for p in PROMPTS)


@query(f"""WITH {_SCORED}, dc AS ({_DECIDED}), c AS (SELECT model, prompt, {_cells_sql('predicted')} FROM dc GROUP BY model, prompt) SELECT model, prompt, tp, fp, tn, fn, {_rates_sql()} FROM c""")
def stored_decision_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hearings as JSON text, one document each, read by their schema, flattened, and their stored decisions scored by model and prompt."""
    d = scored(spark, sf_dir).where("n_chars > 0")
    # JSON as it would lie in a file, keys of decisions and all
    decisions = F.map_from_entries(F.array(*[F.struct(F.lit(f"prompt_{p}_{m}"), F.struct((F.pmod(F.col("doc_id") * (7 * p + i), F.lit(3)) == 0).alias("alucinacao"), F.lit("why").alias("explicacao"))) for i, m in enumerate(MODELS) for p in PROMPTS]))
    head = F.concat(F.lit('{"verificacao_manual": '), F.when(F.col("label") == 1, "true").otherwise("false"), F.lit(", "), F.substring(F.to_json(decisions), 2, 1_000_000))
    person = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "metadados_extraidos": {"assunto": "s", "envolvidos": [{"nome": "n", "opinioes": [{"opiniao": "o", "chunks_proximos": ["a", "b", "c", "d"], "verificacao_alucinacao": '), head, F.lit("}]}]}}"))
    o = opinions(d.select(F.from_json(person, HEARING).alias("h")).select("h.*"))
    rows = pr.decisions(o.select(F.col("sample_id").alias("example_id"), F.col("label").cast("int").alias("label"), "verification"))
    return rounded(me.confusion(rows, ["model", "prompt"], "label", F.col("predicted")), *RATES)


# -- claims and evidence --------------------------------------------------------------------------------------------------


@query()
def labelled_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document, joined where a labelled span touches several, with their label."""
    _, spans = _claims_spans(spark, sf_dir)
    s = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end")))).alias("spans"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(s, "doc_id", "left")
    c = re_.labelled_claims(d, "doc_id", "text", "spans")
    return c.select("doc_id", "claim_index", "claim_start", "claim_end", "label", "example_id", F.sha2("claim", 256).alias("claim_sha256"))


#: The task of a document by its id.
TASKS = ("QA", "Summary", "Data2txt")


@query()
def evidence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence units by task: passages, windows of sentences, or lines of a JSON record."""
    record = F.to_json(F.struct("doc_id", F.struct("lang", "source").alias("origin"), F.array("n_chars").alias("sizes")), {"ignoreNullFields": "false"})
    d = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, TASKS)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("task"), "text", record.alias("record"))
    d = d.select("doc_id", "task", tx.evidence_units("task", F.when(F.col("task") == "Data2txt", F.col("record")).otherwise(F.col("text"))).alias("units"))
    return d.select("doc_id", "task", F.posexplode("units").alias("unit_index", "unit")).select("doc_id", "task", "unit_index", F.sha2("unit", 256).alias("unit_sha256"))


_WORDS4 = "t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS slot, list_filter(list_distinct(string_split(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), ' ')), lambda x: x <> '') AS w FROM conversations)"


@query(f"""WITH {_WORDS4}, p AS (SELECT a.conv_id, CAST(a.slot AS INTEGER) AS slot_a, CAST(b.slot AS INTEGER) AS slot_b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS u FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.slot < b.slot WHERE b.slot <= 4)
           SELECT conv_id, slot_a, slot_b, round(coalesce(i / nullif(CAST(u AS DOUBLE), 0), 0), 8) AS jaccard, coalesce(i / nullif(CAST(u AS DOUBLE), 0), 0) >= 0.9 AS near FROM p""")
def slot_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the four slots of a row (the first four turns of a conversation) by the similarity of their word sets. A blank slot has no words: it is
    like nothing, another blank slot included."""
    c = table(spark, sf_dir, "conversations").withColumn("slot", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("slot <= 4")
    words = F.array_remove(F.array_distinct(F.split(tx.normalise(F.lower("text")), " ")), "")
    wide = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("slot", words.alias("w")))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["slot"] > a["slot"]), lambda b: F.struct(a["slot"].alias("slot_a"), b["slot"].alias("slot_b"), sc.jaccard(a["w"], b["w"]).alias("j")))))
    return wide.select("conv_id", F.explode(pairs).alias("p")).select("conv_id", "p.slot_a", "p.slot_b", F.round("p.j", 8).alias("jaccard"), (F.col("p.j") >= 0.9).alias("near"))


# -- splits and samples ---------------------------------------------------------------------------------------------------


@query(f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_H.format(k='doc_id')}, doc_id) AS k FROM documents)
           SELECT doc_id, lang, CAST(k AS INTEGER) AS stratum_rank FROM r ORDER BY k, lang LIMIT 50""")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents, one of each language in turn."""
    return vw.round_robin_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 50)


@query(f"""WITH g AS (SELECT CAST(substring(source, 4) AS BIGINT) AS source_id, CAST(substring(source, 4) AS BIGINT) % 2 AS task, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS any_positive FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source),
           m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM g GROUP BY task, any_positive)),
           s AS (SELECT g.*, CASE WHEN least >= 2 THEN any_positive ELSE -1 END AS stratum FROM g, m),
           o AS (SELECT *, row_number() OVER (PARTITION BY task, stratum ORDER BY {_H.format(k='source_id')}, source_id) AS r, count(*) OVER (PARTITION BY task, stratum) AS n FROM s)
           SELECT source_id, task, any_positive, CASE WHEN r <= round(n * 0.2::DOUBLE) THEN 'validation' ELSE 'train' END AS partition FROM o""")
def stratified_source_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stratified by task and any positive label; by task alone if a stratum has fewer than two."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring("source", 4, 20).cast("long").alias("source_id"))
    d = d.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    g = d.groupBy("source_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("any_positive")).withColumn("task", F.pmod("source_id", F.lit(2)))
    return vw.stratified_group_split(g, "source_id", ["task", "any_positive"], 0.2, ["task"])


@query()
def nested_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.nested_folds(scored(spark, sf_dir), "source", "label")


# -- linkage ----------------------------------------------------------------------------------------------------------------


@query()
def error_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong decisions by a quality signal and truncation: logistic coefficients of the signals as they are, at unit penalty."""
    s = scored(spark, sf_dir).select(((F.col("s") >= 0.5) != (F.col("label") == 1)).cast("int").alias("error"), F.col("n_chars").alias("quality"), (F.col("n_chars") > 2000).cast("int").alias("truncated"))
    return rounded(qu.logistic_fit(s, "error", ["quality", "truncated"]), "coefficient", digits=6)


_BUCKETS = """e AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3, min(n_chars) AS lo FROM sc),
    b AS (SELECT CAST((CASE WHEN q1 > lo AND q1 < n_chars THEN 1 ELSE 0 END) + (CASE WHEN q2 > q1 AND q2 < n_chars THEN 1 ELSE 0 END) + (CASE WHEN q3 > q2 AND q3 < n_chars THEN 1 ELSE 0 END) AS INTEGER) AS bucket, source, label, s FROM sc, e)"""


@query(f"""WITH {_SCORED}, {_DRAWS}, {_BUCKETS}, gc AS (SELECT source, bucket, {_cells_sql('s >= 0.5')} FROM b GROUP BY source, bucket),
           w AS (SELECT replicate_id, bucket, sum(tp * w) AS tp, sum(fp * w) AS fp, sum(fn * w) AS fn FROM gc JOIN mu ON gc.source = mu.grp GROUP BY 1, 2),
           f AS (SELECT bucket, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM w)
           SELECT bucket, round(avg(f1), 8) AS mean, round(quantile_cont(f1, 0.5), 8) AS median, round(quantile_cont(f1, 0.025), 8) AS ci_low, round(quantile_cont(f1, 0.975), 8) AS ci_high, count(*) AS n_valid FROM f GROUP BY bucket""")
def qcut_f1_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 by quality quartile with a percentile interval over groups."""
    b = qu.quantile_buckets(scored(spark, sf_dir), "n_chars", 4)
    r = bs.replicate_rates(b, _draws(spark, sf_dir), "source", ["bucket"], "label", F.col("s") >= 0.5)
    got = bs.summary(r.select("bucket", "f1"), ["bucket"], "f1")
    return rounded(got.select("bucket", "mean", "median", "ci_low", "ci_high", "n_valid"), "mean", "median", "ci_low", "ci_high")
