"""Audits, transfers and ordered computations over the driver's tables; registered with the other queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.operators import metrics as me
from evidra.operators import quality as qu
from evidra.operators import retrieval as re_
from evidra.operators import views as vw
from evidra.plans.queries import _CUBE, _SCORED, _TOKENS, RATES, _cells_sql, _claims_spans, _rates_sql, cube, query, rounded, scored
from evidra.sources.readers import placed, table

_CHUNKS = """t{n} AS (SELECT doc_id, {tok} AS t FROM documents WHERE text IS NOT NULL AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
    w{n} AS (SELECT doc_id, t, i FROM (SELECT doc_id, t, unnest(range(0, CAST(greatest(0, ceil((len(t) - {size}) / {step}.0)) AS BIGINT) + 1)) AS i FROM t{n})),
    c{n} AS (SELECT doc_id, sha256(array_to_string(list_slice(t, i * {step} + 1, i * {step} + {size}), ' ')) AS h FROM w{n})"""


def _chunks_sql(n: int, size: int, over: int) -> str:
    return _CHUNKS.format(n=n, tok=_TOKENS, size=size, step=size - over)


@query(f"WITH {_chunks_sql(1, 64, 16)} SELECT count(*) AS n_chunks, count(DISTINCT h) AS unique_chunks, count(DISTINCT h) * 384 * 4 AS embedding_bytes, CAST(ceil(count(DISTINCT h) / 256.0) AS BIGINT) AS batches FROM c1")
def size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work ahead of an embedding run: distinct chunks, bytes at 384 dimensions, batches of 256."""
    c = re_.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    n = c.agg(F.count("*").alias("n_chunks"), F.countDistinct("sha256").alias("unique_chunks"))
    return n.select("*", (F.col("unique_chunks") * 384 * 4).alias("embedding_bytes"), F.ceil(F.col("unique_chunks") / 256).alias("batches"))


@query(f"""WITH {_chunks_sql(1, 64, 16)}, {_chunks_sql(2, 64, 0)}, a AS (SELECT DISTINCT doc_id, h FROM c1), b AS (SELECT DISTINCT doc_id, h FROM c2)
           SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_new, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_old""")
def legacy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chunkings compared as sets of (document, text): one grouped pass instead of three set operations."""
    d = table(spark, sf_dir, "documents")
    both = re_.chunks(d, "doc_id", "text").select("doc_id", "sha256", F.lit(1).alias("v")).unionAll(re_.chunks(d, "doc_id", "text", 64, 0).select("doc_id", "sha256", F.lit(2)))
    g = both.groupBy("doc_id", "sha256").agg(F.bool_or(F.col("v") == 1).alias("a"), F.bool_or(F.col("v") == 2).alias("b"))
    return g.agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if(F.col("a") & ~F.col("b")).alias("only_new"), F.count_if(F.col("b") & ~F.col("a")).alias("only_old"))


@query("""WITH s AS (SELECT DISTINCT doc_id, CAST(st AS INTEGER) AS ss, CAST(least(st + 40 + j * 60, n_chars) AS INTEGER) AS se FROM (SELECT doc_id, n_chars, j, (doc_id * 37 + j * 211) % n_chars AS st FROM documents, (SELECT unnest(range(0, 3)) AS j) WHERE n_chars > 0)),
          l AS (SELECT doc_id, ss, se, lead(ss) OVER (PARTITION BY doc_id ORDER BY ss, se) AS nx FROM s WHERE se > ss)
          SELECT doc_id, count(*) AS n_spans, CAST(sum(CASE WHEN nx < se THEN 1 ELSE 0 END) AS BIGINT) AS overlapping, CAST(sum(CASE WHEN nx = se THEN 1 ELSE 0 END) AS BIGINT) AS adjacent FROM l GROUP BY doc_id""")
def span_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, spans = _claims_spans(spark, sf_dir)
    s = spans.withColumn("nx", F.lead("span_start").over(Window.partitionBy("doc_id").orderBy("span_start", "span_end")))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.count_if(F.col("nx") < F.col("span_end")).alias("overlapping"), F.count_if(F.col("nx") == F.col("span_end")).alias("adjacent"))


@query("""WITH c AS (SELECT doc_id, CAST(i * 200 AS INTEGER) AS cs, CAST(least(i * 200 + 200, n_chars) AS INTEGER) AS ce FROM (SELECT doc_id, n_chars, unnest(range(0, CAST(floor((n_chars - 1) / 200.0) AS BIGINT) + 1)) AS i FROM documents WHERE n_chars > 0)),
          s AS (SELECT DISTINCT doc_id, CAST(st AS INTEGER) AS ss, CAST(least(st + 40 + j * 60, n_chars) AS INTEGER) AS se FROM (SELECT doc_id, n_chars, j, (doc_id * 37 + j * 211) % n_chars AS st FROM documents, (SELECT unnest(range(0, 3)) AS j) WHERE n_chars > 0)),
          h AS (SELECT c.doc_id, cs, ss, se, greatest(0, least(ce, se) - greatest(cs, ss)) / CAST(se - ss AS DOUBLE) AS f, count(*) OVER (PARTITION BY c.doc_id, ss, se) > 1 AS x FROM c JOIN s ON c.doc_id = s.doc_id AND ss < ce AND se > cs WHERE se > ss)
          SELECT d.lang, l.quality AS label, count(*) AS n, CAST(sum(CASE WHEN x THEN 1 ELSE 0 END) AS BIGINT) AS crossing, round(avg(f), 8) AS mean_fraction, round(quantile_cont(f, 0.5), 8) AS median_fraction
          FROM h JOIN documents d ON h.doc_id = d.doc_id JOIN labels l ON h.doc_id = l.doc_id GROUP BY 1, 2""")
def boundary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, spans = _claims_spans(spark, sf_dir)
    h = re_.span_overlaps(claims, spans, "doc_id").join(scored(spark, sf_dir).select("doc_id", "lang", "label"), "doc_id")
    g = h.groupBy("lang", "label").agg(F.count("*").alias("n"), F.count_if("crosses").alias("crossing"), F.avg("fraction_span").alias("mean_fraction"), F.percentile("fraction_span", F.lit(0.5)).alias("median_fraction"))
    return rounded(g, "mean_fraction", "median_fraction")


@query("""SELECT claim_sha256, n, CASE WHEN n_sources = 1 AND n_langs = 1 THEN 'same_source' WHEN n_langs > 1 THEN 'cross_language' ELSE 'cross_source' END AS diagnosis, context
          FROM (SELECT sha256(substring(text, 201, 100)) AS claim_sha256, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs, arg_min(substring(text, 21, 460), doc_id) AS context FROM documents WHERE length(text) >= 300 GROUP BY 1 HAVING count(*) > 1)""")
def conflict_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims (characters 200 to 300) that several documents have, with what stands around the first one's."""
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 300)
    d = d.select("doc_id", F.sha2(F.substring("text", 201, 100), 256).alias("claim_sha256"), "source", "lang", vw.context("text", F.lit(200), F.lit(300)).alias("context"))
    g = d.groupBy("claim_sha256").agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"), F.countDistinct("lang").alias("l"), F.min_by("context", "doc_id").alias("context")).where("n > 1")
    why = F.when((F.col("s") == 1) & (F.col("l") == 1), "same_source").when(F.col("l") > 1, "cross_language").otherwise("cross_source")
    return g.select("claim_sha256", "n", why.alias("diagnosis"), "context")


@query("""SELECT doc_id FROM documents ORDER BY (floor(((doc_id * 48271 + 11) % 2147483647) / 7.0)::BIGINT) % 1000003, doc_id LIMIT 100""")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.orderBy(vw.bucket("doc_id", 1_000_003), "doc_id").limit(100)


@query(f"""WITH {_SCORED} SELECT doc_id, label FROM sc WHERE label = 1 OR s >= 0.8 OR (n_chars <= 2000 AND CAST((doc_id * 104729 + 17) % 1000 AS DOUBLE) / 1000 >= 0.8)""")
def strict_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives stay; negatives stay with support from single evidence, or from joined evidence that was not cut."""
    s = scored(spark, sf_dir).withColumn("joined", F.pmod(F.col("doc_id") * 104729 + 17, F.lit(1000)) / 1000.0).withColumn("cut", F.col("n_chars") > 2000)
    return s.where((F.col("label") == 1) | (F.col("s") >= 0.8) | (~F.col("cut") & (F.col("joined") >= 0.8))).select("doc_id", "label")


_HALF = "CAST(floor(((doc_id * 48271 + 11) % 2147483647) / 7.0) AS BIGINT) % 2"
_TRANSFER = f"""{_CUBE}, hv AS (SELECT *, {_HALF} AS half FROM cb), th AS (SELECT DISTINCT condition, seed, score AS t FROM hv WHERE half = 0),
    pt AS (SELECT h.condition, h.seed, t, sum(CASE WHEN score >= t AND label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score >= t AND label = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN score < t AND label = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN score < t AND label = 0 THEN 1 ELSE 0 END) AS tn
           FROM (SELECT * FROM hv WHERE half = 0) h JOIN th ON h.condition = th.condition AND h.seed = th.seed GROUP BY 1, 2, 3
           UNION ALL SELECT condition, seed, t, sum(label), sum(1 - label), 0, 0 FROM hv, (SELECT 0.0::DOUBLE AS t) WHERE half = 0 GROUP BY 1, 2, 3),
    bt AS (SELECT condition, seed, t FROM (SELECT *, row_number() OVER (PARTITION BY condition, seed ORDER BY 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) DESC, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) DESC, CAST(fp AS DOUBLE) / nullif(fp + tn, 0), t DESC) AS r FROM pt) WHERE r = 1)"""


def _transfer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = cube(spark, sf_dir).withColumn("half", vw.bucket("doc_id", 2))
    best = me.select_threshold(me.operating_points(c.where("half = 0"), ["condition", "seed"], "label", "score"), ["condition", "seed"], "f1")
    return c.where("half = 1"), best.select("condition", "seed", "threshold")


@query(f"""WITH {_TRANSFER}, x AS (SELECT h.condition, CAST(h.seed AS INTEGER) AS seed, t AS threshold, {_cells_sql('score >= t')} FROM hv h JOIN bt ON h.condition = bt.condition AND h.seed = bt.seed WHERE half = 1 GROUP BY 1, 2, 3)
           SELECT condition, seed, threshold, tp, fp, tn, fn, {_rates_sql()} FROM x""")
def threshold_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds frozen on one half of the documents, applied to the other: few thresholds, broadcast."""
    target, frozen = _transfer(spark, sf_dir)
    j = target.join(F.broadcast(frozen), ["condition", "seed"])
    return rounded(me.confusion(j, ["condition", "seed", "threshold"], "label", F.col("score") >= F.col("threshold")), *RATES)


@query(f"WITH {_TRANSFER} SELECT b.condition, CAST(b.seed AS INTEGER) AS seed, true AS unchanged FROM bt b")
def threshold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen thresholds against ones chosen again."""
    _, frozen = _transfer(spark, sf_dir)
    _, again = _transfer(spark, sf_dir)
    j = frozen.join(again.withColumnRenamed("threshold", "t2"), ["condition", "seed"])
    return j.select("condition", "seed", (F.abs(F.col("threshold") - F.col("t2")) <= 1e-12).alias("unchanged"))


@query(f"""WITH {_SCORED} SELECT CAST(least(floor(s * 10), 9) AS INTEGER) AS bin, CAST(label AS INTEGER) AS label, count(*) AS n, round(avg(s), 8) AS mean_score FROM sc GROUP BY 1, 2""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).groupBy(F.least(F.floor(F.col("s") * 10), F.lit(9)).cast("int").alias("bin"), "label")
    return rounded(s.agg(F.count("*").alias("n"), F.avg("s").alias("mean_score")), "mean_score")


@query(f"WITH {_SCORED} SELECT doc_id, s AS score, CAST(label AS INTEGER) AS label FROM sc ORDER BY s DESC, doc_id LIMIT 200")
def top_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).orderBy(F.desc("s"), "doc_id").limit(200).select("doc_id", F.col("s").alias("score"), "label")


@query(f"""WITH {_SCORED}, e AS (SELECT quantile_cont(s, 0.25) AS a, quantile_cont(s, 0.5) AS b, quantile_cont(s, 0.75) AS c FROM sc)
           SELECT d.doc_id, CASE WHEN s IS NULL THEN 'missing' ELSE 'q' || CAST((a <= s)::INTEGER + (b <= s)::INTEGER + (c <= s)::INTEGER AS VARCHAR) END AS bin FROM documents d LEFT JOIN sc ON d.doc_id = sc.doc_id, e""")
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartile bins of labelled documents' scores, counted by edges passed; documents without a score are missing."""
    s = scored(spark, sf_dir).select("doc_id", "s")
    edges = s.agg(F.percentile("s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e"))
    j = table(spark, sf_dir, "documents").select("doc_id").join(s, "doc_id", "left").join(F.broadcast(edges))
    return j.select("doc_id", F.when(F.col("s").isNull(), "missing").otherwise(F.concat(F.lit("q"), F.size(F.filter("e", lambda x: x <= F.col("s"))).cast("string"))).alias("bin"))


@query("""WITH k AS (SELECT conv_id, turn, length(text) AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, max(length(text)) OVER (PARTITION BY conv_id) AS m, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
          SELECT conv_id, max(n) AS n_turns, max(n) - max(CASE WHEN v = m THEN r END) AS since_best FROM k GROUP BY conv_id""")
def turns_since_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing steps below the best value of a sequence."""
    c = table(spark, sf_dir, "conversations").withColumn("v", F.length("text"))
    w = Window.partitionBy("conv_id")
    c = c.withColumns({"r": F.row_number().over(w.orderBy("turn")), "m": F.max("v").over(w)})
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), (F.count("*") - F.max(F.when(F.col("v") == F.col("m"), F.col("r")))).alias("since_best"))


@query("""WITH k AS (SELECT conv_id || ':' || turn AS id, conv_id, turn FROM conversations) SELECT id, CAST(row_number() OVER (ORDER BY conv_id, turn) AS INTEGER) AS place FROM k ORDER BY conv_id, turn LIMIT 100""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids `a:b` in the order of their numbers."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"))
    number = F.transform(F.split("id", ":"), lambda x: x.cast("long"))
    top = c.orderBy(number).limit(100)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(number)))


@query(f"""WITH {_SCORED}, f AS (SELECT source, CAST(floor(((CAST(substring(source, 4) AS BIGINT) * 48271 + 11) % 2147483647) / 7.0) AS BIGINT) % 5 AS fold FROM (SELECT DISTINCT source FROM sc)),
           r AS (SELECT sc.doc_id, count(*) AS n FROM sc JOIN f ON sc.source = f.source GROUP BY sc.doc_id), h AS (SELECT source, count(DISTINCT fold) AS k FROM f GROUP BY source)
           SELECT (SELECT count(*) FROM r) AS covered, (SELECT count(*) FROM r WHERE n <> 1) AS repeated, (SELECT count(*) FROM h WHERE k <> 1) AS leaking""")
def fold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one test fold, every group in one fold."""
    s = scored(spark, sf_dir).select("doc_id", "source").withColumn("fold", vw.bucket(F.substring("source", 4, 10).cast("long"), 5))
    rows = s.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("covered"), F.count_if(F.col("n") != 1).alias("repeated"))
    leaks = s.groupBy("source").agg(F.countDistinct("fold").alias("k")).agg(F.count_if(F.col("k") != 1).alias("leaking"))
    return rows.join(F.broadcast(leaks))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents), b AS (SELECT d.doc_id, row_number() OVER (ORDER BY d.doc_id) AS q FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
          SELECT count(*) AS n, count(*) FILTER (WHERE later <= earlier) AS out_of_order FROM (SELECT p AS later, lag(p) OVER (ORDER BY q) AS earlier FROM a JOIN b ON a.doc_id = b.doc_id)""")
def order_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a filtered output (the labels) keeps the input's order (the documents), both as their files hold them."""
    source = placed(table(spark, sf_dir, "documents"), "earlier").select("doc_id", "earlier")
    kept = placed(table(spark, sf_dir, "labels"), "later").select("doc_id", "later")
    return qu.order_breaks(kept.join(source, "doc_id"), "earlier", "later")


@query("""WITH p AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'assistant') AS assistants, max(CASE WHEN role = 'system' THEN length(text) END) AS system_chars FROM conversations GROUP BY conv_id)
          SELECT conv_id, users, assistants, coalesce(system_chars, -1) AS system_chars, users = assistants AS balanced FROM p""")
def role_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"), F.max(F.when(F.col("role") == "system", F.length("text"))).alias("s"))
    return c.select("conv_id", "users", "assistants", F.coalesce("s", F.lit(-1)).alias("system_chars"), (F.col("users") == F.col("assistants")).alias("balanced"))


@query(f"""WITH {_SCORED}, q AS (SELECT CAST(label AS INTEGER) AS label, avg(s) AS mean, stddev_pop(s) AS std, quantile_cont(s, 0.05) AS p5, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.95) AS p95 FROM sc GROUP BY 1)
           SELECT label, round(mean, 8) AS mean, round(std, 8) AS std, round(p5, 8) AS p5, round(p50, 8) AS p50, round(p95, 8) AS p95 FROM q""")
def score_spread_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = scored(spark, sf_dir).groupBy("label").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.percentile("s", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    return rounded(g.select("label", "mean", "std", *[F.col("q")[i].alias(k) for i, k in enumerate(("p5", "p50", "p95"))]), "mean", "std", "p5", "p50", "p95")


@query()
def support_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hallucination score of each labelled document from masked slots of entailment scores: 1 less the best valid one."""
    from evidra.functions.models import max_entailment

    slots = F.array(*[F.pmod(F.col("doc_id") * a + 7, F.lit(1000)) / 1000.0 for a in (7919, 104729, 6101, 8191)])
    mask = F.array(*[F.col("n_chars") > k * 400 for k in range(4)])
    d = scored(spark, sf_dir).select("doc_id", "label", slots.alias("e"), mask.alias("m"))
    best = max_entailment(F.col("e"), F.col("m"))
    return d.select("doc_id", "label", best.alias("support"), (1 - best).alias("hallucination_score"), (F.array_position("e", best) - 1).cast("int").alias("best_slot"))
