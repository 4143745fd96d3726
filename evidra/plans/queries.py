"""The engine's operators as queries over the driver's tables, each with its SQL where SQL can state it.

Roles: documents.source is the group, labels.quality the label, linear congruences of doc_id are the scores of conditions and seeds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions import scalars as sc
from evidra.functions import text as tx
from evidra.operators import bootstrap as bs
from evidra.operators import cost as ct
from evidra.operators import metrics as me
from evidra.operators import prompts as pr
from evidra.operators import quality as qu
from evidra.operators import report as rp
from evidra.operators import retrieval as re_
from evidra.operators import views as vw
from evidra.sources.readers import table
from evidra.sources.writers import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Replicates of the bootstrap queries.
REPLICATES = 1000


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *cols: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# -- the scored population -------------------------------------------------------------------------------------------

#: (condition, seed) -> multiplier and offset of the score's congruence.
SCORES = {("base", 0): (7919, 13), ("base", 1): (6101, 29), ("tuned", 0): (104729, 17), ("tuned", 1): (15485863, 5), ("pool", 0): (2750159, 3), ("pool", 1): (611953, 71), ("set", 0): (8191, 41), ("set", 1): (131071, 19)}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_chars, label and score s of every labelled document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    j = d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return j.withColumn("s", F.pmod(F.col("doc_id") * 7919 + 13, F.lit(1000)) / 1000.0)


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table (condition, seed, doc_id, source, label, score): one scan, exploded."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(s).alias("seed"), (F.pmod(F.col("doc_id") * a + b, F.lit(1000)) / 1000.0).alias("score")) for (c, s), (a, b) in SCORES.items()]))
    return scored(spark, sf_dir).select("doc_id", "source", "label", rows.alias("x")).select("doc_id", "source", "label", "x.*")


_SCORED = "sc AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, CAST(l.quality AS INTEGER) AS label, CAST((d.doc_id * 7919 + 13) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS s FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_CUBE = _SCORED + ", cb AS (" + " UNION ALL ".join(f"SELECT '{c}' AS condition, {s} AS seed, doc_id, source, label, CAST((doc_id * {a} + {b}) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score FROM sc" for (c, s), (a, b) in SCORES.items()) + ")"


def _rates_sql(tp: str = "tp", fp: str = "fp", tn: str = "tn", fn: str = "fn") -> str:
    d = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"
    return f"""round({d(tp, f'({tp}+{fp})')}, 8) AS precision, round({d(tp, f'({tp}+{fn})')}, 8) AS recall, round({d(f'2*{tp}', f'(2*{tp}+{fp}+{fn})')}, 8) AS f1,
        round({d(f'({tp}+{tn})', f'({tp}+{fp}+{tn}+{fn})')}, 8) AS accuracy, round(({d(tp, f'({tp}+{fn})')} + {d(tn, f'({tn}+{fp})')}) / 2, 8) AS balanced_accuracy,
        round(coalesce((CAST({tp} AS DOUBLE)*{tn}-CAST({fp} AS DOUBLE)*{fn}) / nullif(sqrt(CAST({tp}+{fp} AS DOUBLE)*({tp}+{fn})*({tn}+{fp})*({tn}+{fn})), 0), 0), 8) AS mcc,
        round({d(fp, f'({fp}+{tn})')}, 8) AS fpr, round({d(tn, f'({tn}+{fp})')}, 8) AS specificity"""


RATES = ["precision", "recall", "f1", "accuracy", "balanced_accuracy", "mcc", "fpr", "specificity"]


def _cells_sql(pred: str, w: str = "1") -> str:
    return ", ".join(f"CAST(sum(CASE WHEN {c} THEN {w} ELSE 0 END) AS BIGINT) AS {k}" for k, c in (("tp", f"label = 1 AND {pred}"), ("fp", f"label <> 1 AND {pred}"), ("tn", f"label <> 1 AND NOT ({pred})"), ("fn", f"label = 1 AND NOT ({pred})")))


def _ranking_sql(src: str, keys: str, w: str = "1") -> str:
    """average_precision, auroc and brier of src (keys, label, score), weights w."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""a AS (SELECT {k}score, CAST(sum({w} * label) AS DOUBLE) AS pos, CAST(sum({w}) AS DOUBLE) AS n FROM {src} GROUP BY {k}score),
        b AS (SELECT *, sum(pos) OVER ({part} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp, sum(n) OVER ({part} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn,
                     sum(pos) OVER ({part}) AS tp, sum(n) OVER ({part}) AS tn FROM a),
        rk AS (SELECT {k}sum(coalesce(pos / nullif(tp, 0), 0) * cp / cn) AS average_precision, sum((n - pos) * (cp - pos / 2) / nullif(tp * (tn - tp), 0)) AS auroc,
                      sum(pos * (score - 1) * (score - 1) + (n - pos) * score * score) / sum(n) AS brier, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives FROM b {'GROUP BY ' + keys if keys else ''})"""


# -- retrieval --------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT a.vec_id AS claim_id, a.label, b.vec_id AS evidence_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
                     FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
          r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, evidence_id) AS rank FROM p)
          SELECT claim_id, label, evidence_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 4""")
def top4_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return rounded(re_.dense_top_k(e.where("vec_id % 50 = 0"), e, "label", "vec_id", "vec_id", "embedding"), "score", digits=6)


@query("""WITH p AS (SELECT a.vec_id AS claim_id, b.vec_id AS evidence_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
                     FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
          r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, evidence_id) AS rank FROM p),
          w AS (SELECT claim_id, """ + ", ".join(f"max(CASE WHEN rank = {i} THEN evidence_id END) AS e{i}, max(CASE WHEN rank = {i} THEN score END) AS s{i}" for i in range(1, 5)) + """ FROM r GROUP BY claim_id)
          SELECT claim_id, """ + ", ".join(f"coalesce(e{i}, -1) AS chunk_{i}_id, round(s{i}, 6) AS chunk_{i}_score" for i in range(1, 5)) + ", CAST(" + " + ".join(f"(e{i} IS NOT NULL)::INTEGER" for i in range(1, 5)) + " AS INTEGER) AS n_valid FROM w")
def top4_slots_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    w = re_.slots_wide(re_.dense_top_k(e.where("vec_id % 50 = 0"), e, "label", "vec_id", "vec_id", "embedding"))
    return rounded(w.withColumn("n_valid", F.size(F.filter("evidence_mask", lambda x: x))).drop("evidence_mask"), *[f"chunk_{i}_score" for i in range(1, 5)], digits=6)


_TFIDF = """WITH k AS (SELECT conv_id AS g, conv_id * 1000 + turn AS id, role, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+') AS w, trim(regexp_replace(text, '\\s', ' ', 'g')) AS t FROM conversations),
    u AS (SELECT * FROM (SELECT g, id, w, row_number() OVER (PARTITION BY g ORDER BY id) AS o FROM k WHERE role <> 'assistant' AND t <> '') WHERE o <= 128),
    n AS (SELECT g, count(*) AS n FROM u GROUP BY g), c AS (SELECT k.id AS claim, k.g, w, coalesce(n, 0) AS n FROM k LEFT JOIN n ON k.g = n.g WHERE role = 'assistant'),
    bag AS (SELECT claim, 0 AS o, n, w FROM c UNION ALL SELECT c.claim, u.o, n, u.w FROM c JOIN u ON c.g = u.g),
    tm AS (SELECT claim, o, n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM bag),
    tf AS (SELECT claim, o, n, x, count(*) AS tf FROM tm GROUP BY ALL), df AS (SELECT claim, x, count(*) AS df FROM tf GROUP BY ALL),
    v AS (SELECT tf.claim, o, tf.x, tf * (ln((2.0 + n) / (1.0 + df)) + 1) AS v FROM tf JOIN df ON tf.claim = df.claim AND tf.x = df.x),
    nm AS (SELECT claim, o, sqrt(sum(v * v)) AS nm FROM v GROUP BY ALL), p AS (SELECT a.claim, b.o, sum(a.v * b.v) AS p FROM v a JOIN v b ON a.claim = b.claim AND a.x = b.x WHERE a.o = 0 AND b.o > 0 GROUP BY ALL),
    s AS (SELECT c.claim, u.id, u.o, CASE WHEN n > 4 THEN coalesce(p / (x.nm * y.nm), 0.0) END AS s FROM c JOIN u ON c.g = u.g LEFT JOIN p ON c.claim = p.claim AND u.o = p.o LEFT JOIN nm x ON c.claim = x.claim AND x.o = 0 LEFT JOIN nm y ON c.claim = y.claim AND y.o = u.o),
    r AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY round(coalesce(s, 0), 9) DESC, o) AS r FROM s)
    SELECT c.claim AS claim_id, CAST(i AS INTEGER) AS rank, r.id AS unit_id, round(s, 8) AS score, r.id IS NOT NULL AS mask FROM (SELECT claim, unnest(range(1, 5)) AS i FROM c) c LEFT JOIN r ON c.claim = r.claim AND c.i = r.r"""


@query(_TFIDF)
def tfidf_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns against the other turns of their conversation, four slots each."""
    c = table(spark, sf_dir, "conversations").withColumn("turn_id", F.col("conv_id") * 1000 + F.col("turn"))
    got = re_.tfidf_top_k(c.where("role = 'assistant'"), c.where("role <> 'assistant'"), "conv_id", "turn_id", "turn_id", "text")
    return rounded(got, "score")


_TOKENS = "string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')"


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
           w AS (SELECT doc_id, t, CAST(i AS INTEGER) AS i FROM (SELECT doc_id, t, unnest(range(0, CAST(greatest(0, ceil((len(t) - 64) / 48.0)) AS BIGINT) + 1)) AS i FROM t)),
           c AS (SELECT doc_id, i AS window_index, CAST(i * 48 AS INTEGER) AS token_start, CAST(least(i * 48 + 64, len(t)) AS INTEGER) AS token_end, array_to_string(list_slice(t, i * 48 + 1, i * 48 + 64), ' ') AS text FROM w)
           SELECT doc_id, window_index, token_start, token_end, sha256(text) AS sha256 FROM c""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "window_index", "token_start", "token_end", "sha256")


def _claims_spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", F.col("n_chars").cast("int").alias("n"))
    claims = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 200).cast("int"))).alias("i"))
    claims = claims.select("doc_id", (F.col("i") * 200).alias("claim_start"), F.least(F.col("i") * 200 + 200, "n").alias("claim_end"))
    spans = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    start = F.pmod(F.col("doc_id") * 37 + F.col("j") * 211, F.col("n")).cast("int")
    spans = spans.select("doc_id", start.alias("span_start"), F.least(start + 40 + F.col("j") * 60, "n").alias("span_end")).where("span_end > span_start").distinct()
    return claims, spans


@query("""WITH c AS (SELECT doc_id, CAST(i * 200 AS INTEGER) AS cs, CAST(least(i * 200 + 200, n_chars) AS INTEGER) AS ce FROM (SELECT doc_id, n_chars, unnest(range(0, CAST(floor((n_chars - 1) / 200.0) AS BIGINT) + 1)) AS i FROM documents WHERE n_chars > 0)),
          s AS (SELECT DISTINCT doc_id, CAST(st AS INTEGER) AS ss, CAST(least(st + 40 + j * 60, n_chars) AS INTEGER) AS se FROM (SELECT doc_id, n_chars, j, (doc_id * 37 + j * 211) % n_chars AS st FROM documents, (SELECT unnest(range(0, 3)) AS j) WHERE n_chars > 0)),
          h AS (SELECT c.doc_id, cs, ce, ss, se, greatest(0, least(ce, se) - greatest(cs, ss)) AS o FROM c JOIN s ON c.doc_id = s.doc_id AND ss < ce AND se > cs WHERE se > ss)
          SELECT doc_id, cs AS claim_start, ce AS claim_end, ss AS span_start, se AS span_end, CAST(o AS INTEGER) AS overlap_chars, round(o / CAST(greatest(1, ce - cs) AS DOUBLE), 8) AS fraction_claim,
                 round(o / CAST(greatest(1, se - ss) AS DOUBLE), 8) AS fraction_span, count(*) OVER (PARTITION BY doc_id, ss, se) > 1 AS crosses FROM h""")
def claim_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, spans = _claims_spans(spark, sf_dir)
    return rounded(re_.span_overlaps(claims, spans, "doc_id"), "fraction_claim", "fraction_span")


@query()
def sentence_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.sentence_claims(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "claim_index", "claim_start", "claim_end", "example_id", F.sha2("claim", 256).alias("claim_sha256"))


# -- text features ----------------------------------------------------------------------------------------------------


@query("""SELECT l.quality AS label, count(*) AS n, round(avg(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[''’-][\\p{L}\\p{N}_]+)*'))), 6) AS n_words, round(avg(length(text)), 6) AS n_chars,
                 round(avg(CAST(regexp_matches(text, '[0-9]') AS INTEGER)), 6) AS has_digit, round(avg(CAST(regexp_matches(text, '[.!?؟。！？]\\s*$') AS INTEGER)), 6) AS ends_sentence, round(avg(CAST(regexp_matches(text, '["“”‘’]') AS INTEGER)), 6) AS has_quote,
                 round(avg(CAST(regexp_matches(text, '(?:^|\\n|\\s)(?:\\*|[-•]|\\(?\\d+[.)]|[A-Za-z][.)])\\s') AS INTEGER)), 6) AS enumeration
          FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality""")
def surface_features_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tx.surface("text")
    names = ("n_words", "n_chars", "has_digit", "ends_sentence", "has_quote", "enumeration")
    d = table(spark, sf_dir, "documents").select("doc_id", *[f[c].alias(c) for c in names])
    j = d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("quality").alias("label"))
    return rounded(j.agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("int")).alias(c) for c in names]), *names, digits=6)


@query(f"""WITH {_SCORED} SELECT label, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(coalesce(stddev_samp(n_chars), 0), 6) AS std, CAST(min(n_chars) AS DOUBLE) AS min, CAST(max(n_chars) AS DOUBLE) AS max,
           round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.75), 6) AS p75, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM sc GROUP BY label""")
def distribution_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(me.distribution(scored(spark, sf_dir), ["label"], "n_chars"), "mean", "std", "p50", "p75", "p90", "p95", digits=6)


@query(f"""WITH {_SCORED}, g AS (SELECT lang, count(CASE WHEN label = 1 THEN 1 END) AS n1, count(CASE WHEN label = 0 THEN 1 END) AS n0, avg(CASE WHEN label = 1 THEN n_chars END) AS m1, avg(CASE WHEN label = 0 THEN n_chars END) AS m0,
             coalesce(var_samp(CASE WHEN label = 1 THEN n_chars END), 0) AS v1, coalesce(var_samp(CASE WHEN label = 0 THEN n_chars END), 0) AS v0 FROM sc GROUP BY lang)
           SELECT lang, round(coalesce((m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / nullif(n1 + n0 - 2, 0)), 0), 0), 8) AS cohen_d FROM g""")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(me.cohen_d(scored(spark, sf_dir), ["lang"], "label", "n_chars"), "cohen_d")


_PAIRS = "pr AS (SELECT conv_id, turn, text AS target, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, role FROM conversations)"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn as target of the user turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("source", F.lag("text").over(w)).withColumn("prev", F.lag("role").over(w))
    return c.where("role = 'assistant' AND prev = 'user'").select("conv_id", "turn", "source", F.col("text").alias("target"))


@query(f"""WITH {_PAIRS}, n AS (SELECT conv_id, turn, length(coalesce(source, '')) AS a, length(coalesce(target, '')) AS b, trim(regexp_replace(coalesce(source, ''), '\\s+', ' ', 'g')) AS x, trim(regexp_replace(coalesce(target, ''), '\\s+', ' ', 'g')) AS y FROM pr WHERE role = 'assistant' AND prev = 'user')
           SELECT conv_id, turn, CAST(a AS INTEGER) AS source_chars, CAST(b AS INTEGER) AS target_chars, CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END::INTEGER AS source_words, CASE WHEN y = '' THEN 0 ELSE len(string_split(y, ' ')) END::INTEGER AS target_words,
                  round(CAST(b AS DOUBLE) / nullif(a, 0), 8) AS ratio, x <> '' AND y = '' AS target_empty, x = y AS identical,
                  coalesce(CAST(b AS DOUBLE) / nullif(a, 0) < 0.4, false) AS low_ratio, coalesce(CAST(b AS DOUBLE) / nullif(a, 0) > 2.5, false) AS high_ratio FROM n""")
def length_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = turn_pairs(spark, sf_dir)
    return rounded(p.select("conv_id", "turn", *[v.alias(k) for k, v in tx.length_metrics("source", "target").items()]), "ratio")


_RUNS = f"""{_PAIRS}, ps AS (SELECT conv_id, turn, coalesce(source, '') AS source, coalesce(target, '') AS target FROM pr WHERE role = 'assistant' AND prev = 'user'),
    sd AS (SELECT conv_id, turn, 's' AS side, source AS x FROM ps UNION ALL SELECT conv_id, turn, 't', target FROM ps),
    tk AS (SELECT conv_id, turn, side, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT conv_id, turn, side, string_split(lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))), ' ') AS t FROM sd)),
    un AS (SELECT tk.*, u, lead(tok, u) OVER (PARTITION BY conv_id, turn, side, u ORDER BY i) = tok AS same FROM tk, (SELECT unnest(range(1, 4)) AS u) WHERE tok <> ''),
    il AS (SELECT conv_id, turn, side, u, same, i - row_number() OVER (PARTITION BY conv_id, turn, side, u, same ORDER BY i) AS g FROM un),
    rn AS (SELECT conv_id, turn, side, u, max(n) AS r FROM (SELECT conv_id, turn, side, u, g, CASE WHEN same THEN count(*) ELSE 0 END AS n FROM il GROUP BY conv_id, turn, side, u, g, same) GROUP BY 1, 2, 3, 4),
    rl AS (SELECT ps.conv_id, ps.turn, {", ".join(f"coalesce(max(CASE WHEN side = 't' AND u = {u} THEN r // {u} + 1 END), 0)::INTEGER AS run_{u}" for u in (1, 2, 3))}, coalesce(max(CASE WHEN side = 's' THEN r // u + 1 END), 0)::INTEGER AS src, any_value(source) AS source, any_value(target) AS target
           FROM ps LEFT JOIN rn ON ps.conv_id = rn.conv_id AND ps.turn = rn.turn GROUP BY ps.conv_id, ps.turn),
    sv AS (SELECT *, greatest(run_1, run_2, run_3) AS longest_run, CASE WHEN greatest(run_1, run_2, run_3) < 2 OR greatest(run_1, run_2, run_3) <= src THEN 'none' WHEN greatest(run_1, run_2, run_3) >= 4 AND greatest(run_1, run_2, run_3) >= src + 2 THEN 'high'
                  WHEN greatest(run_1, run_2, run_3) >= 3 THEN 'medium' ELSE 'low' END AS repetition, CAST(length(target) AS DOUBLE) / nullif(length(source), 0) AS ratio FROM rl),
    ex AS (SELECT *, coalesce(ratio < 0.4 OR ratio > 2.5, false) OR repetition = 'high' AS excluded FROM sv)"""


@query(f"""WITH {_RUNS} SELECT conv_id, turn, run_1, run_2, run_3, longest_run, repetition, excluded FROM ex""")
def repetition_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = qu.pair_flags(turn_pairs(spark, sf_dir), "source", "target")
    return p.select("conv_id", "turn", "run_1", "run_2", "run_3", "longest_run", "repetition", "excluded")


@query(f"""WITH {_RUNS} SELECT conv_id, bool_or(excluded) AS candidate, count(*) FILTER (WHERE excluded) AS n_excluded, count(*) AS n_pairs FROM ex GROUP BY conv_id""")
def exclusion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of which any pair is excluded."""
    p = qu.pair_flags(turn_pairs(spark, sf_dir), "source", "target")
    return p.groupBy("conv_id").agg(F.bool_or("excluded").alias("candidate"), F.count_if("excluded").alias("n_excluded"), F.count("*").alias("n_pairs"))


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ')) AS w FROM conversations),
          p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM t)
          SELECT conv_id, turn, round(coalesce(len(list_intersect(w, v)) / CAST(nullif(len(w) + len(v) - len(list_intersect(w, v)), 0) AS DOUBLE), 0), 8) AS jaccard, coalesce(len(list_intersect(w, v)) / CAST(nullif(len(w) + len(v) - len(list_intersect(w, v)), 0) AS DOUBLE), 0) >= 0.9 AS near FROM p WHERE v IS NOT NULL""")
def neighbour_turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(tx.tokens(F.lower("text"))).alias("w"))
    c = c.withColumn("v", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("v IS NOT NULL")
    s = sc.jaccard("w", "v")
    return c.select("conv_id", "turn", F.round(s, 8).alias("jaccard"), (s >= 0.9).alias("near"))


# -- training views ---------------------------------------------------------------------------------------------------


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return d.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


@query("""SELECT lang AS source, sha256(concat_ws(chr(31), lang, text)) AS duplicate_group_id, count(*) AS n, count(DISTINCT l.quality) > 1 AS conflict
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang, text""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.duplicate_groups(labelled_texts(spark, sf_dir), "lang", "text", "quality").select("source", "duplicate_group_id", "n", "conflict")


@query("""WITH g AS (SELECT lang, text, count(*) AS n, count(DISTINCT l.quality) > 1 AS conflict, count(DISTINCT n_chars) > 1 OR count(DISTINCT coalesce(l.toxic, -1)) > 1 AS differs FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang, text)
          SELECT CASE WHEN conflict THEN 'drop_conflict' WHEN differs THEN 'drop_input_mismatch' WHEN n > 1 THEN 'collapse' ELSE 'singleton' END AS decision, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM g GROUP BY 1""")
def dedup_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = labelled_texts(spark, sf_dir).withColumnRenamed("source", "site").withColumns({"source": F.col("lang"), "claim": F.col("text")})
    groups = vw.duplicate_groups(t, "source", "claim", "quality")
    diff = vw.input_differences(t, ["source", "claim"], "doc_id", ["n_chars", "toxic"], [])
    return vw.decisions(groups, diff, ["source", "claim"]).groupBy("decision").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))


@query("""SELECT doc_id, lang, source, CAST(n_chars AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY CAST(doc_id AS VARCHAR)) AS r FROM documents) WHERE r = 1""")
def representative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))
    return vw.representatives(d, ["text_sha256"], [F.col("doc_id").cast("string")]).select("doc_id", "lang", "source", "n_chars", "text_sha256")


@query("""WITH b AS (SELECT sha256(text) AS text_sha256, CAST(floor(((doc_id * 48271 + 11) % 2147483647) / 7.0) AS BIGINT) % 3 AS split FROM documents)
          SELECT text_sha256, array_to_string(list_sort(list_distinct(list(CAST(split AS VARCHAR)))), ',') AS splits, count(*) AS n FROM b GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def group_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_sha256"), vw.bucket("doc_id", 3).cast("string").alias("split"))
    return vw.group_leaks(d, "text_sha256", "split").withColumn("splits", F.array_join("splits", ","))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN lang <> 'en' THEN 'other_language' END, CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 20000 THEN 'long' END, CASE WHEN text NOT LIKE '%.%' THEN 'no_sentence' END], lambda x: x IS NOT NULL), ';') AS reasons FROM documents""")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", sc.reasons(";", other_language=F.col("lang") != "en", short=F.col("n_chars") < 200, long=F.col("n_chars") > 20000, no_sentence=~F.col("text").contains(".")).alias("reasons"))


@query("""WITH b AS (SELECT doc_id, lang, (floor(((doc_id * 48271 + 11) % 2147483647) / 7.0)::BIGINT) % 1000003 AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS k FROM b)
          SELECT doc_id, lang, CAST(k AS INTEGER) AS stratum_rank FROM r ORDER BY CAST(k > 1 AS INTEGER), h, doc_id LIMIT 50""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 50)


@query("""SELECT doc_id, source, CAST(r AS INTEGER) AS rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5""")
def first_n_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.first_per_key(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 5)


@query()
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.grouped_split(scored(spark, sf_dir), "source", "label", 0.2)


@query()
def k_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.k_folds(scored(spark, sf_dir), "source", "label")


@query(f"""WITH {_SCORED}, n AS (SELECT lang, count(*) AS c FROM sc GROUP BY lang) SELECT doc_id, lang, round(1.0::DOUBLE / c, 10) AS weight FROM sc JOIN n USING (lang)""")
def sampler_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).select("doc_id", "lang")
    return s.join(s.groupBy("lang").agg(F.count("*").alias("c")), "lang").select("doc_id", "lang", F.round(1.0 / F.col("c"), 10).alias("weight"))


# -- metrics and thresholds -------------------------------------------------------------------------------------------


@query(f"WITH {_SCORED}, c AS (SELECT lang, {_cells_sql('s >= 0.5')} FROM sc GROUP BY lang) SELECT lang, tp, fp, tn, fn, {_rates_sql()} FROM c")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(me.confusion(scored(spark, sf_dir), ["lang"], "label", F.col("s") >= 0.5), *RATES)


@query(f"WITH {_CUBE}, {_ranking_sql('cb', 'condition, seed')} SELECT condition, CAST(seed AS INTEGER) AS seed, round(average_precision, 8) AS average_precision, round(auroc, 8) AS auroc, round(brier, 8) AS brier, n, positives FROM rk")
def ap_auroc_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(me.ranking(cube(spark, sf_dir), ["condition", "seed"], "label", "score"), "average_precision", "auroc", "brier")


_POINTS = f"""{_SCORED}, th AS (SELECT DISTINCT s AS t FROM sc UNION SELECT 0.0::DOUBLE UNION SELECT 1.0::DOUBLE UNION SELECT 1.0000000000000002::DOUBLE),
    pt AS (SELECT t, CAST(sum(CASE WHEN s >= t AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN s >= t AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
                  CAST(sum(CASE WHEN s < t AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN s < t AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM sc, th GROUP BY t),
    pm AS (SELECT t AS threshold, tp, fp, tn, fn, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall, coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0) AS fpr FROM pt)"""
_POINT_COLS = "threshold, tp, fp, tn, fn, round(f1, 8) AS f1, round(recall, 8) AS recall, round(fpr, 8) AS fpr"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.operating_points(scored(spark, sf_dir), [], "label", "s")


def _best(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    got = me.select_threshold(_points(spark, sf_dir), [], rule)
    return rounded(got.select("threshold", "tp", "fp", "tn", "fn", "f1", "recall", "fpr"), "f1", "recall", "fpr")


@query(f"WITH {_POINTS} SELECT {_POINT_COLS} FROM pm")
def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_points(spark, sf_dir).select("threshold", "tp", "fp", "tn", "fn", "f1", "recall", "fpr"), "f1", "recall", "fpr")


@query(f"WITH {_POINTS} SELECT {_POINT_COLS} FROM (SELECT * FROM pm ORDER BY f1 DESC, recall DESC, fpr ASC, threshold DESC LIMIT 1)")
def threshold_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, "f1")


@query(f"WITH {_POINTS} SELECT {_POINT_COLS} FROM (SELECT * FROM pm WHERE fpr <= 0.1 + 1e-12 ORDER BY recall DESC, f1 DESC, fpr ASC, threshold ASC LIMIT 1)")
def threshold_fpr10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, "fpr")


@query(f"WITH {_POINTS} SELECT {_POINT_COLS} FROM (SELECT * FROM pm WHERE fpr <= 0.1 + 1e-12 ORDER BY recall DESC, fpr ASC, threshold DESC LIMIT 1)")
def threshold_operational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, "operational")


@query(f"WITH {_CUBE}, e AS (SELECT condition, doc_id, max(label) AS label, avg(score) AS score FROM cb GROUP BY condition, doc_id), c AS (SELECT condition, {_cells_sql('score >= 0.5')} FROM e GROUP BY condition) SELECT condition, tp, fp, tn, fn, {_rates_sql()} FROM c")
def ensemble_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cube(spark, sf_dir).groupBy("condition", "doc_id").agg(F.max("label").alias("label"), F.avg("score").alias("score"))
    return rounded(me.confusion(e, ["condition"], "label", F.col("score") >= 0.5), *RATES)


@query(f"WITH {_SCORED} SELECT source, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 8) AS prevalence, round(CAST(count(*) - sum(label) AS DOUBLE) / nullif(sum(label), 0), 8) AS pos_weight, bool_or(label = 1) AS any_positive FROM sc GROUP BY source")
def prevalence_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.avg("label").alias("prevalence"), F.bool_or(F.col("label") == 1).alias("any_positive"))
    return rounded(g.withColumn("pos_weight", F.try_divide((F.col("n") - F.col("positives")).cast("double"), F.col("positives"))), "prevalence", "pos_weight")


# -- bootstrap --------------------------------------------------------------------------------------------------------

_DRAWS = f"""gi AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM sc)), gn AS (SELECT count(*) AS G FROM gi),
    dw AS (SELECT r, G, ((((((r * 1000003 + d * 7919 + 12345) % 2147483647) * 48271 + 11) % 2147483647) * 69621 + 7) % 2147483647) AS x FROM (SELECT r, G, unnest(range(0, G)) AS d FROM gn, (SELECT unnest(range(0, {REPLICATES})) AS r))),
    mu AS (SELECT CAST(r AS BIGINT) AS replicate_id, source AS grp, count(*) AS w FROM (SELECT r, (CAST(floor(x / 128.0) AS BIGINT)) % G AS i FROM dw) q JOIN gi ON q.i = gi.i GROUP BY r, source)"""
_REPS = f"""{_CUBE}, {_DRAWS}, jn AS (SELECT replicate_id, condition, seed, label, score, w FROM cb JOIN mu ON cb.source = mu.grp), {_ranking_sql('jn', 'replicate_id, condition, seed', 'w')},
    rv AS (SELECT replicate_id, condition, seed, CASE WHEN positives > 0 AND positives < n THEN average_precision END AS average_precision, CASE WHEN positives > 0 AND positives < n THEN auroc END AS auroc,
                  CASE WHEN positives > 0 AND positives < n THEN brier END AS brier, n, positives FROM rk)"""
_LONG = f"""{_REPS}, ml AS (SELECT replicate_id, condition, seed, 'average_precision' AS metric, average_precision AS value FROM rv UNION ALL SELECT replicate_id, condition, seed, 'auroc', auroc FROM rv UNION ALL SELECT replicate_id, condition, seed, 'brier', brier FROM rv),
    mm AS (SELECT replicate_id, condition, metric, avg(value) AS value FROM ml GROUP BY 1, 2, 3)"""
PAIRS = {"tuned_vs_base": ("base", "tuned"), "set_vs_pool": ("pool", "set")}
_DELTAS = f"""{_LONG}, dl AS ({' UNION ALL '.join(f"SELECT a.replicate_id, a.metric, '{k}' AS contrast, round(b.value - a.value, 12) AS delta FROM mm a JOIN mm b ON a.replicate_id = b.replicate_id AND a.metric = b.metric WHERE a.condition = '{x}' AND b.condition = '{y}'" for k, (x, y) in PAIRS.items())})"""


def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bs.multiplicities(scored(spark, sf_dir).select("source"), "source", REPLICATES)


def _replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bs.replicate_metrics_matrix(cube(spark, sf_dir), _draws(spark, sf_dir), "source", ["condition", "seed"], "label", "score")


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = bs.melted(_replicates(spark, sf_dir).drop("valid", "n", "positives"), ["replicate_id", "condition", "seed"], ["average_precision", "auroc", "brier"])
    mean = long.groupBy("replicate_id", "condition", "metric").agg(F.avg("value").alias("value"))
    return rounded(bs.contrasts(mean, ["replicate_id", "metric"], "condition", PAIRS), "delta", digits=12)


@query(f"WITH {_SCORED}, {_DRAWS} SELECT replicate_id, grp AS \"group\", w FROM mu")
def bootstrap_multiplicities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _draws(spark, sf_dir)


@query(f"WITH {_REPS} SELECT replicate_id, condition, CAST(seed AS INTEGER) AS seed, round(average_precision, 12) AS average_precision, round(auroc, 12) AS auroc, round(brier, 12) AS brier, n, positives FROM rv")
def bootstrap_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_replicates(spark, sf_dir).drop("valid"), "average_precision", "auroc", "brier", digits=12)


@query(f"WITH {_DELTAS} SELECT replicate_id, metric, contrast, round(delta, 8) AS delta FROM dl")
def pairwise_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_deltas(spark, sf_dir), "delta")


@query(f"WITH {_DELTAS} SELECT a.replicate_id, a.metric, 'tuning_minus_pooling' AS interaction, round(a.delta - b.delta, 8) AS delta FROM dl a JOIN dl b ON a.replicate_id = b.replicate_id AND a.metric = b.metric WHERE a.contrast = 'tuned_vs_base' AND b.contrast = 'set_vs_pool'")
def interaction_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bs.interactions(_deltas(spark, sf_dir), ["replicate_id", "metric"], {"tuning_minus_pooling": ("tuned_vs_base", "set_vs_pool")}), "delta")


_SUMMARY = f"""{_DELTAS}, sm AS (SELECT contrast, metric, avg(delta) AS mean, quantile_cont(delta, 0.5) AS median, quantile_cont(delta, 0.025) AS ci_low, quantile_cont(delta, 0.975) AS ci_high,
    avg(CASE WHEN delta > 0 THEN 1.0::DOUBLE ELSE 0 END) AS p_positive, avg(CASE WHEN delta < 0 THEN 1.0::DOUBLE ELSE 0 END) AS p_negative, count(*) AS n_valid FROM dl WHERE delta IS NOT NULL GROUP BY 1, 2)"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bs.summary(_deltas(spark, sf_dir), ["contrast", "metric"])


@query(f"WITH {_SUMMARY} SELECT contrast, metric, round(mean, 8) AS mean, round(median, 8) AS median, round(ci_low, 8) AS ci_low, round(ci_high, 8) AS ci_high, p_positive, p_negative, n_valid FROM sm")
def bootstrap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_summary(spark, sf_dir), "mean", "median", "ci_low", "ci_high")


@query(f"""WITH {_SUMMARY} SELECT contrast, metric, CASE WHEN (ci_low > 0 AND metric NOT IN ('brier', 'fpr')) OR (ci_high < 0 AND metric IN ('brier', 'fpr')) THEN 'FAVOR_B' WHEN ci_low > 0 OR ci_high < 0 THEN 'FAVOR_A' ELSE 'INCONCLUSIVE' END AS verdict,
           ci_low <= 0 AND ci_high >= 0 AS crosses_zero FROM sm""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).select("contrast", "metric", bs.verdict().alias("verdict"), ((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)).alias("crosses_zero"))


@query(f"""WITH {_CUBE}, {_DRAWS}, gc AS (SELECT source, condition, seed, {_cells_sql('score >= 0.4')} FROM cb GROUP BY 1, 2, 3),
           w AS (SELECT replicate_id, condition, CAST(seed AS INTEGER) AS seed, {', '.join(f'CAST(sum({c} * w) AS BIGINT) AS {c}' for c in ('tp', 'fp', 'tn', 'fn'))} FROM gc JOIN mu ON gc.source = mu.grp GROUP BY 1, 2, 3)
           SELECT replicate_id, condition, seed, tp, fp, tn, fn, {_rates_sql()} FROM w""")
def thresholded_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bs.replicate_rates(cube(spark, sf_dir), _draws(spark, sf_dir), "source", ["condition", "seed"], "label", F.col("score") >= 0.4)
    return rounded(got, *RATES)


# -- reports ----------------------------------------------------------------------------------------------------------

_BY_RUN = f"{_CUBE}, c AS (SELECT condition, seed, {_cells_sql('score >= 0.5')} FROM cb GROUP BY condition, seed), rt AS (SELECT condition, CAST(seed AS INTEGER) AS seed, {_rates_sql()} FROM c)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(me.confusion(cube(spark, sf_dir), ["condition", "seed"], "label", F.col("score") >= 0.5), *RATES)


@query(f"WITH {_BY_RUN} SELECT condition, round(avg(f1), 7) AS f1_mean, round(stddev_samp(f1), 7) AS f1_std, round(min(f1), 7) AS f1_min, round(max(f1), 7) AS f1_max, round(avg(mcc), 7) AS mcc_mean, round(stddev_samp(mcc), 7) AS mcc_std FROM rt GROUP BY condition")
def seed_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir).groupBy("condition")
    f = {"f1_mean": F.avg("f1"), "f1_std": F.stddev_samp("f1"), "f1_min": F.min("f1"), "f1_max": F.max("f1"), "mcc_mean": F.avg("mcc"), "mcc_std": F.stddev_samp("mcc")}
    return rounded(r.agg(*[v.alias(k) for k, v in f.items()]), *f, digits=7)


@query(f"WITH {_BY_RUN} SELECT condition, seed, f1, mcc, fpr, CAST(row_number() OVER (ORDER BY f1 DESC, mcc DESC, fpr, condition, seed) AS INTEGER) AS rank FROM rt")
def ranked_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("f1"), F.desc("mcc"), "fpr", "condition", "seed")
    return _runs(spark, sf_dir).select("condition", "seed", "f1", "mcc", "fpr", F.row_number().over(w).alias("rank"))


@query(f"""WITH {_BY_RUN} SELECT metric, max(CASE WHEN condition = 'base' THEN v END) AS base, max(CASE WHEN condition = 'tuned' THEN v END) AS tuned, round(max(CASE WHEN condition = 'tuned' THEN v END) - max(CASE WHEN condition = 'base' THEN v END), 7) AS gain
           FROM (SELECT condition, 'f1' AS metric, round(avg(f1), 7) AS v FROM rt GROUP BY 1 UNION ALL SELECT condition, 'recall', round(avg(recall), 7) FROM rt GROUP BY 1 UNION ALL SELECT condition, 'fpr', round(avg(fpr), 7) FROM rt GROUP BY 1) GROUP BY metric""")
def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = bs.melted(_runs(spark, sf_dir).select("condition", "f1", "recall", "fpr"), ["condition"], ["f1", "recall", "fpr"])
    wide = long.groupBy("metric").pivot("condition", ["base", "tuned"]).agg(F.round(F.avg("value"), 7))
    return wide.withColumn("gain", F.round(F.col("tuned") - F.col("base"), 7))


@query(f"WITH {_SCORED} SELECT lang, CAST(label AS VARCHAR) AS label, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM sc GROUP BY GROUPING SETS ((lang, label), (lang), (label), ())")
def grouping_sets_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = scored(spark, sf_dir).groupingSets([["lang", "label"], ["lang"], ["label"], []], "lang", "label")
    return rounded(g.agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars")), "mean_chars", digits=6).withColumn("label", F.col("label").cast("string"))


@query(f"WITH {_CUBE}, n AS (SELECT doc_id, count(*) AS n, count(DISTINCT label) AS l, count(DISTINCT source) AS h FROM cb GROUP BY doc_id) SELECT count(*) AS examples, CAST(sum(CASE WHEN n <> {len(SCORES)} OR l <> 1 OR h <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS unpaired FROM n")
def pairing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = cube(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("label").alias("l"), F.countDistinct("source").alias("h"))
    return n.agg(F.count("*").alias("examples"), F.count_if(F.expr(f"n <> {len(SCORES)} OR l <> 1 OR h <> 1")).alias("unpaired"))


# -- translation quality ----------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id % 97 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN 'xx' ELSE lang END AS lang, source, CASE WHEN doc_id % 29 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 89 <> 0)
          SELECT CAST(sum(CASE WHEN b.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_source, CAST(sum(CASE WHEN a.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_target,
                 CAST(sum(CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.lang IS DISTINCT FROM b.lang THEN 1 ELSE 0 END) AS BIGINT) AS lang_mismatch, CAST(sum(CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.source IS DISTINCT FROM b.source THEN 1 ELSE 0 END) AS BIGINT) AS source_mismatch,
                 CAST(sum(CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.n_chars IS DISTINCT FROM b.n_chars THEN 1 ELSE 0 END) AS BIGINT) AS n_chars_mismatch FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""")
def align_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    changed = d.where("doc_id % 89 <> 0").withColumns({"lang": F.when(F.col("doc_id") % 41 == 0, "xx").otherwise(F.col("lang")), "n_chars": F.when(F.col("doc_id") % 29 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return qu.alignment_gate(d.where("doc_id % 97 <> 0"), changed, "doc_id", ["lang", "source", "n_chars"])


@query("""SELECT 'missing' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'extra', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def id_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(labels, "doc_id", "left_anti").select(F.lit("missing").alias("side"), "doc_id").unionAll(labels.join(d, "doc_id", "left_anti").select(F.lit("extra").alias("side"), "doc_id"))


@query("""WITH s AS (SELECT conv_id, CASE WHEN role = 'system' THEN 'claim' ELSE 'chunk' END AS role, CAST(length(text) AS DOUBLE) / 100 AS score, length(text) > 400 AS flag FROM conversations)
          SELECT conv_id, bool_or(flag) AS any_flag, round(min(score), 8) AS min_score, round(avg(score), 8) AS mean_score, round(max(score), 8) AS max_score, round(max(CASE WHEN role = 'claim' THEN score END), 8) AS claim_score, round(avg(CASE WHEN role <> 'claim' THEN score END), 8) AS rest_score, count(*) AS n_segments FROM s GROUP BY conv_id""")
def segment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("role") == "system", "claim").otherwise("chunk").alias("role"), (F.length("text").cast("double") / 100).alias("score"), (F.length("text") > 400).alias("flag"))
    return rounded(qu.roll_up(c, "conv_id", "score", "flag"), "min_score", "mean_score", "max_score", "claim_score", "rest_score")


@query(f"WITH {_SCORED} SELECT doc_id, round(-(label * ln(greatest(least(s, 1 - 1e-6), 1e-6)) + (1 - label) * ln(1 - greatest(least(s, 1 - 1e-6), 1e-6))), 8) AS log_loss, round(abs(greatest(least(s, 1 - 1e-6), 1e-6) - label), 8) AS abs_error, (s >= 0.5) = (label = 1) AS correct FROM sc")
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.select("doc_id", F.round(sc.log_loss("label", "s"), 8).alias("log_loss"), F.round(F.abs(sc.clip("s", 1e-6, 1 - 1e-6) - F.col("label")), 8).alias("abs_error"), ((F.col("s") >= 0.5) == (F.col("label") == 1)).alias("correct"))


@query(f"""WITH {_SCORED}, e AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3, min(n_chars) AS lo, max(n_chars) AS hi FROM sc),
           b AS (SELECT CAST((CASE WHEN q1 > lo AND q1 < n_chars THEN 1 ELSE 0 END) + (CASE WHEN q2 > q1 AND q2 < n_chars THEN 1 ELSE 0 END) + (CASE WHEN q3 > q2 AND q3 < n_chars THEN 1 ELSE 0 END) AS INTEGER) AS bucket, label, s FROM sc, e),
           c AS (SELECT bucket, {_cells_sql('s >= 0.5')} FROM b GROUP BY bucket) SELECT bucket, tp, fp, tn, fn, {_rates_sql()} FROM c""")
def qcut_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = qu.quantile_buckets(scored(spark, sf_dir), "n_chars", 4)
    return rounded(me.confusion(b, ["bucket"], "label", F.col("s") >= 0.5), *RATES)


@query(f"""WITH {_SCORED}, ct AS (SELECT i, CASE WHEN i = 0 THEN (SELECT min(n_chars) - 1 FROM sc)::DOUBLE ELSE quantile_cont END AS cut FROM ({' UNION ALL '.join(f'SELECT {i} AS i, (SELECT quantile_cont(n_chars, {0.9 * i / 20}) FROM sc) AS quantile_cont' for i in range(21))})),
           f AS (SELECT CAST(i AS INTEGER) AS step, label, s AS score FROM sc JOIN ct ON n_chars >= cut), {_ranking_sql('f', 'step')}
           SELECT step, n, positives, round(average_precision, 8) AS average_precision, round(auroc, 8) AS auroc FROM rk WHERE positives > 0 AND positives < n""")
def filtered_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = qu.filtered_steps(scored(spark, sf_dir), "n_chars", ["s", "label"])
    r = me.ranking(f, ["step"], "label", "s", F.col("w")).where("positives > 0 AND positives < n")
    return rounded(r.select("step", "n", "positives", "average_precision", "auroc"), "average_precision", "auroc")


@query(f"""WITH {_SCORED}, v AS (SELECT -(label * ln(greatest(least(s, 1 - 1e-6), 1e-6)) + (1 - label) * ln(1 - greatest(least(s, 1 - 1e-6), 1e-6))) AS t, CAST(n_chars AS DOUBLE) AS n_chars, s FROM sc),
           lg AS (SELECT t, 'n_chars' AS signal, n_chars AS v FROM v UNION ALL SELECT t, 's', s FROM v),
           rk AS (SELECT signal, t, v, rank() OVER (PARTITION BY signal ORDER BY t) + (count(*) OVER (PARTITION BY signal, t) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY signal ORDER BY v) + (count(*) OVER (PARTITION BY signal, v) - 1) / 2.0 AS rv FROM lg)
           SELECT signal, count(*) AS n, round(corr(v, t), 6) AS pearson, round(corr(rv, rt), 6) AS spearman FROM rk GROUP BY signal""")
def signal_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("t", sc.log_loss("label", "s"))
    return rounded(qu.correlations(s, ["n_chars", "s"], "t"), "pearson", "spearman", digits=6)


# -- prompts, cost, nested data ------------------------------------------------------------------------------------------------

#: Prompts over benchmark items: evidence is the item's paragraphs, the opinion its first words.
TEMPLATES = [("prompt_1", "sys one", "T: {TEXTO} O: {OPINIAO}"), ("prompt_2", "sys two", "{OPINIAO} given {TEXTO}")]


@query("""WITH e AS (SELECT item_id, replace(text, chr(10), chr(10) || chr(10)) AS ev, substring(text, 1, 20) AS op FROM benchmark)
          SELECT item_id, 'prompt_1' AS prompt_id, 'sys one' AS system_message, sha256('T: ' || ev || ' O: ' || op) AS message_sha256, CAST(length('T: ' || ev || ' O: ' || op) AS INTEGER) AS n_chars FROM e
          UNION ALL SELECT item_id, 'prompt_2', 'sys two', sha256(op || ' given ' || ev), CAST(length(op || ' given ' || ev) AS INTEGER) FROM e""")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", "\n").alias("evidence"), F.substring("text", 1, 20).alias("opinion"))
    m = pr.messages(b, spark.createDataFrame(TEMPLATES, "prompt_id string, system string, user_template string"))
    return m.select("item_id", "prompt_id", "system_message", F.sha2("user_message", 256).alias("message_sha256"), F.length("user_message").alias("n_chars"))


@query("""WITH t AS (SELECT role, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS c FROM conversations)
          SELECT role, CAST(sum(c) AS BIGINT) AS total, round(avg(c), 8) AS mean, CAST(quantile_cont(c, 0.5) AS DOUBLE) AS median, count(*) AS n FROM t GROUP BY role""")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("role", F.size(tx.tokens("text")).alias("c"))
    return rounded(pr.token_totals(c, ["role"], "c"), "mean")


@query(f"""WITH {_BY_RUN} SELECT condition, seed, round(r.f1 - rt.f1, 7) AS f1, round(r.mcc - rt.mcc, 7) AS mcc, round(rt.fpr - r.fpr, 7) AS fpr
           FROM rt, (SELECT f1, mcc, fpr FROM rt WHERE condition = 'set' AND seed = 0) r WHERE NOT (condition = 'set' AND seed = 0)""")
def reference_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir).select("condition", "seed", "f1", "mcc", "fpr")
    return rounded(rp.deltas(r, (F.col("condition") == "set") & (F.col("seed") == 0), ["f1", "mcc", "fpr"]), "f1", "mcc", "fpr", digits=7)


#: Model, input and output price in units of a million tokens.
PRICES = [("large", "2.50", "10.00"), ("small", "0.15", "0.60"), ("local", "0.96952", "3.87807")]
_COST = f"""tk AS (SELECT role, CAST(sum(len({_TOKENS})) AS BIGINT) AS input_tokens, CAST(sum(length(text)) AS BIGINT) AS output_tokens FROM conversations GROUP BY role),
    px AS ({' UNION ALL '.join(f"SELECT '{m}' AS model, CAST({a} AS DECIMAL(18,13)) AS ip, CAST({b} AS DECIMAL(18,13)) AS op" for m, a, b in PRICES)}),
    co AS (SELECT role, model, input_tokens, output_tokens, CAST(input_tokens AS DOUBLE) * CAST(ip AS DOUBLE) / 1e6 AS ic, CAST(output_tokens AS DOUBLE) * CAST(op AS DOUBLE) / 1e6 AS oc FROM tk, px)"""


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("role", F.size(tx.tokens("text")).cast("long").alias("input_tokens"), F.length("text").cast("long").alias("output_tokens"))
    # totals first: prices then meet one row a role
    t = t.groupBy("role").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    prices = spark.createDataFrame(PRICES, "model string, ip string, op string").select("model", F.col("ip").cast("decimal(18,13)").alias("input_price"), F.col("op").cast("decimal(18,13)").alias("output_price"))
    models = t.withColumn("model", F.explode(F.array(*[F.lit(m) for m, _, _ in PRICES])))
    return ct.costs(models, prices, ["role"])


@query(f"WITH {_COST} SELECT role, model, input_tokens, output_tokens, round(ic, 9) AS input_cost, round(oc, 9) AS output_cost FROM co")
def cost_by_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(spark, sf_dir).select("role", "model", "input_tokens", "output_tokens", F.round(F.col("input_cost").cast("double"), 9).alias("input_cost"), F.round(F.col("output_cost").cast("double"), 9).alias("output_cost"))


@query(f"WITH {_COST}, c AS (SELECT model, sum(ic + oc) AS total FROM co GROUP BY model) SELECT model, round(total, 9) AS campaign_cost, round(total / (SELECT total FROM c WHERE model = 'local'), 9) AS ratio FROM c")
def cost_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.campaign(_costs(spark, sf_dir), "local").select("model", F.round(F.col("campaign_cost").cast("double"), 9).alias("campaign_cost"), F.round("ratio", 9).alias("ratio"))


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) % 10 AS k10, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2""")
def nested_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int"))
    return rounded(e.groupBy("event_type", F.pmod("p.k", F.lit(10)).alias("k10")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")), "mean_value", digits=6)


@query("""WITH m AS (SELECT label, unnest([1, 2, 3, 4]) AS chunk, unnest([embedding[1], embedding[2], embedding[3], embedding[4]]) AS v FROM embeddings)
          SELECT label, CAST(chunk AS INTEGER) AS chunk, round(avg(CAST(v AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST(v AS DOUBLE)), 6) AS std, count(*) AS n FROM m GROUP BY label, chunk""")
def attention_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 4)).alias("i", "v"))
    g = e.groupBy("label", (F.col("i") + 1).alias("chunk")).agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_samp(F.col("v").cast("double")).alias("std"), F.count("*").alias("n"))
    return rounded(g, "mean", "std", digits=6)


@query()
def surface_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced logistic regression on surface features alone, fitted on one part of a grouped split, scored on the other."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    f = tx.surface("text")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", *[v.cast("double").alias(k) for k, v in f.items()])
    d = d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    # the fit and the scores read the features several times; texts are read once
    d = settled(d.withColumn("held", vw.bucket(F.crc32(F.col("source").cast("binary")), 5) == 0), "surface")
    n = d.where("NOT held").groupBy("label").agg(F.count("*").alias("c"))
    train = d.where("NOT held").join(F.broadcast(n), "label").withColumn("w", 1.0 / F.col("c"))
    to = VectorAssembler(inputCols=list(f), outputCol="raw")
    scale = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(to.transform(train))
    model = LogisticRegression(featuresCol="x", weightCol="w", regParam=1e-3, maxIter=50).fit(scale.transform(to.transform(train)))
    out = model.transform(scale.transform(to.transform(d.where("held"))))
    return out.select("doc_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))
