"""Evidence for claims: chunk windows, dense and sparse top-k inside a source, fixed slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import text as tx
from evidra.functions.scalars import dot, overlap, padded_slots, safe_divide

SLOTS = 4


def chunks(df: DataFrame, id_col: str, text_col: str, size: int = 64, overlap_tokens: int = 16) -> DataFrame:
    """Token windows of a text: (id, window_index, token_start, token_end, text, sha256, chunk_key). The last window is the
    first that reaches the end."""
    step = size - overlap_tokens
    t = df.select(F.col(id_col), tx.tokens(text_col).alias("__t")).where(F.size("__t") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("__t") - size) / step)).cast("int")
    w = t.select(id_col, "__t", F.explode(F.sequence(F.lit(0), last)).alias("window_index"))
    start = F.col("window_index") * step
    w = w.select(id_col, "window_index", start.alias("token_start"), F.least(start + size, F.size("__t")).alias("token_end"), F.array_join(F.slice("__t", start + 1, F.lit(size)), " ").alias("text"))
    w = w.withColumn("sha256", F.sha2("text", 256))
    return w.withColumn("chunk_key", F.concat_ws(":", F.col(id_col).cast("string"), "window_index", F.substring("sha256", 1, 16)))


def dense_top_k(claims: DataFrame, evidence: DataFrame, group: str, claim_id: str, evidence_id: str, vector: str, k: int = SLOTS) -> DataFrame:
    """The k evidence rows of a claim's own group with the largest inner product; ties by evidence id. An equi-join on the
    group, the window limits each claim's rows before it sorts."""
    e = evidence.select(F.col(group).alias("__g"), F.col(evidence_id).alias("evidence_id"), F.col(vector).alias("__v"))
    pairs = claims.select(F.col(claim_id).alias("claim_id"), F.col(group), F.col(vector).alias("__u")).join(e, (F.col(group) == F.col("__g")) & (F.col("evidence_id") != F.col("claim_id")))
    scored = pairs.select("claim_id", group, "evidence_id", dot("__u", "__v").alias("score"))
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("score"), "evidence_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def slots_wide(top: DataFrame, claim_id: str = "claim_id", k: int = SLOTS) -> DataFrame:
    """One row a claim: chunk_i_id (-1 if empty), chunk_i_score (null if empty) and the mask."""
    got = top.groupBy(claim_id).agg(F.array_sort(F.collect_list(F.struct("rank", "evidence_id", "score"))).alias("s"))
    empty = F.struct(F.lit(-1).cast("int").alias("rank"), F.lit(-1).cast("long").alias("evidence_id"), F.lit(None).cast("double").alias("score"))
    got = got.withColumn("s", padded_slots("s", empty, k))
    cols = [c for i in range(k) for c in (F.col("s")[i]["evidence_id"].alias(f"chunk_{i + 1}_id"), F.col("s")[i]["score"].alias(f"chunk_{i + 1}_score"))]
    return got.select(claim_id, *cols, F.transform("s", lambda x: x["evidence_id"] >= 0).alias("evidence_mask"))


def terms_of(text: Column | str) -> Column:
    """Lower-cased words and pairs of neighbouring words, with repeats."""
    c = F.col(text) if isinstance(text, str) else text
    w = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def tfidf_top_k(claims: DataFrame, units: DataFrame, group: str, claim_id: str, unit_id: str, text_col: str, k: int = SLOTS, most: int = 128) -> DataFrame:
    """k slots a claim (claim_id, rank, unit_id, score, mask): the units of its group that are most like it by the cosine of smoothed tf-idf vectors over words and word
    pairs, where the corpus is the claim and its group's units. Texts are stripped, blank units left out, and the first `most` units of a group by id are its units: both are
    part of the definition. Equal scores (to 9 digits) go by unit id. Up to k units are all kept in order without a score; slots without a unit have mask false. Claim ids
    are unique; a claim of a null or unknown group has empty slots only.

    Terms of units and their frequencies are counted once a group. A claim raises the document frequency of its own terms by one, so a unit's squared norm is its own over
    the group plus a correction for the terms it shares with the claim: only the claims' terms are joined, on (group, term), with lists of at most `most` units."""
    g = F.col(group).alias("__g")
    u = units.select(g, F.col(unit_id).cast("long").alias("unit_id"), F.regexp_replace(text_col, r"(?U)^\s+|\s+$", "").alias("t")).where("t <> '' AND __g IS NOT NULL")
    u = u.withColumn("o", F.row_number().over(Window.partitionBy("__g").orderBy("unit_id", "t"))).where(F.col("o") <= most)
    sizes = u.groupBy("__g").agg(F.max("o").alias("n"), F.array_sort(F.collect_list(F.struct("o", "unit_id"))).alias("all"))
    c = claims.select(F.col(claim_id).alias("claim_id"), g, F.col(text_col).alias("t")).join(sizes.select("__g", "n"), "__g", "left")
    tf = u.select("__g", "o", F.explode(terms_of("t")).alias("term")).groupBy("__g", "o", "term").agg(F.count("*").alias("tf"))
    lists = tf.groupBy("__g", "term").agg(F.collect_list(F.struct("o", "tf")).alias("in"))

    def idf(n: Column | str, df: Column) -> Column:
        return F.ln((F.lit(2.0) + n) / (F.lit(1.0) + df)) + 1

    own = lists.join(sizes.select("__g", "n"), "__g").select("__g", F.explode("in").alias("i"), F.pow(idf(F.col("n"), F.size("in")), F.lit(2.0)).alias("w2"))
    own = own.groupBy("__g", F.col("i.o").alias("o")).agg(F.sum(F.pow("i.tf", F.lit(2.0)) * F.col("w2")).alias("own"))
    own = own.groupBy("__g").agg(F.map_from_entries(F.collect_list(F.struct("o", "own"))).alias("own"))
    ct = c.where(F.col("n") > k).select("claim_id", "__g", "n", F.explode(terms_of("t")).alias("term")).groupBy("claim_id", "__g", "n", "term").agg(F.count("*").alias("ctf"))
    j = ct.join(lists, ["__g", "term"], "left")
    df = F.greatest(F.size("in"), F.lit(0))
    j = j.select("claim_id", "ctf", F.pow(idf(F.col("n"), df + 1), F.lit(2.0)).alias("w1"), F.pow(idf(F.col("n"), df), F.lit(2.0)).alias("w0"), "in")
    # Ordinal 0 is the claim itself: its product is its squared norm.
    j = j.select("*", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("o"), F.col("ctf").alias("tf"))), F.coalesce("in", F.array().cast("array<struct<o:int,tf:bigint>>")))).alias("i"))
    m = j.groupBy("claim_id", F.col("i.o").alias("o")).agg(F.sum(F.col("ctf") * F.col("i.tf") * F.col("w1")).alias("p"), F.sum(F.pow("i.tf", F.lit(2.0)) * (F.col("w1") - F.col("w0"))).alias("more"))
    m = m.groupBy("claim_id").agg(F.map_from_entries(F.collect_list(F.struct("o", F.struct("p", "more")))).alias("m"))
    r = c.select("claim_id", "__g", "n").join(sizes.select("__g", "all"), "__g", "left").join(own, "__g", "left").join(m, "claim_id", "left")

    def score(x: Column) -> Column:
        hit = F.element_at("m", x["o"])
        norm = F.sqrt((F.element_at("own", x["o"]) + hit["more"]) * F.element_at("m", F.lit(0))["p"])
        return F.when(F.col("n") > k, F.coalesce(safe_divide(hit["p"], norm), F.lit(0.0)))

    ranked = F.array_sort(F.transform("all", lambda x: F.struct((-F.round(F.coalesce(score(x), F.lit(0.0)), 9)).alias("by"), x["o"].alias("o"), x["unit_id"].alias("unit_id"), score(x).alias("score"))))
    slots = r.select("claim_id", F.coalesce(ranked, F.array().cast("array<struct<by:double,o:int,unit_id:bigint,score:double>>")).alias("s"))
    slots = slots.select("claim_id", "s", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    at = F.get("s", F.col("rank") - 1)
    return slots.select("claim_id", "rank", at["unit_id"].alias("unit_id"), at["score"].alias("score"), at.isNotNull().alias("mask"))


def span_overlaps(claims: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Claims (key, claim_start, claim_end) with the labelled spans (key, span_start, span_end) they touch: characters shared, shares of
    claim and span, and whether the span touches other claims, too."""
    hit = claims.join(spans, key).where((F.col("span_start") < F.col("claim_end")) & (F.col("span_end") > F.col("claim_start")))
    n = overlap("claim_start", "claim_end", "span_start", "span_end")
    hit = hit.withColumn("overlap_chars", n)
    hit = hit.withColumn("fraction_claim", F.col("overlap_chars") / F.greatest(F.lit(1), F.col("claim_end") - F.col("claim_start"))).withColumn("fraction_span", F.col("overlap_chars") / F.greatest(F.lit(1), F.col("span_end") - F.col("span_start")))
    w = Window.partitionBy(key, "span_start", "span_end")
    return hit.withColumn("crosses", F.count("*").over(w) > 1)


def sentence_claims(df: DataFrame, id_col: str, text_col: str, min_words: int = 3) -> DataFrame:
    """A row for each sentence with at least min_words words: claim_index counts all sentences, so indices may skip."""
    s = df.select(F.col(id_col), F.posexplode(tx.sentence_texts(text_col)).alias("claim_index", "r"))
    s = s.select(id_col, "claim_index", F.col("r.start").alias("claim_start"), F.col("r.end").alias("claim_end"), F.col("r.text").alias("claim"))
    return s.where(tx.has_words("claim", min_words)).withColumn("example_id", F.concat_ws(":", F.col(id_col).cast("string"), "claim_start", "claim_end"))


def labelled_claims(df: DataFrame, id_col: str, text_col: str, spans_col: str, min_words: int = 3, granularity: str = "claim", merge: bool = True) -> DataFrame:
    """Claims of responses with their label: sentences, those that a labelled span joins as one (unless merge is false), with at least
    min_words words; or the whole response. spans_col: array of (start, end). example_id, claim_index, claim_start, claim_end, claim, label."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.coalesce(F.col(spans_col), F.array().cast("array<struct<start:int,end:int>>"))
    if granularity == "response":
        whole = df.select(id_col, F.lit(0).alias("claim_index"), F.lit(0).alias("claim_start"), F.length(t).alias("claim_end"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "").alias("claim"), (F.size(spans) > 0).alias("label"))
        return whole.where("claim <> ''").withColumn("example_id", F.concat_ws(":", F.col(id_col).cast("string"), "claim_start", "claim_end"))
    if granularity != "claim":
        raise ValueError(f"granularity must be claim or response, not {granularity}")
    claims = tx.joined_sentences(t, spans) if merge else tx.sentence_texts(t)
    # the label is set before rows are made of the claims: these don't carry the text or the spans
    rows = F.transform(claims, lambda r: F.struct(r["start"].alias("claim_start"), r["end"].alias("claim_end"), r["text"].alias("claim"), label_of(r, spans).alias("label")))
    s = df.select(F.col(id_col), F.posexplode(rows).alias("claim_index", "__r")).select(id_col, "claim_index", "__r.*")
    return s.where(tx.has_words("claim", min_words)).withColumn("example_id", F.concat_ws(":", F.col(id_col).cast("string"), "claim_start", "claim_end"))


def label_of(claim: Column, spans: Column) -> Column:
    """Whether any span (struct start, end) touches the claim (struct start, end)."""
    return F.exists(spans, lambda s: (s["start"] < claim["end"]) & (s["end"] > claim["start"]))
