"""Rewriting nested hearings: translate the text leaves of valid opinions, leave everything else as it is, and check that."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.functions.text import blank


def valid(opinion: Column, size: int = 4) -> Column:
    c = opinion["chunks_proximos"]
    return F.coalesce(~blank(opinion["opiniao"]) & (F.size(c) == size) & ~F.exists(c, blank), F.lit(False))


def mapped(hearings: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """Hearings with change applied to each opinion, in place."""
    people = F.transform("metadados_extraidos.envolvidos", lambda p: p.withField("opinioes", F.transform(p["opinioes"], change)))
    return hearings.withColumn("metadados_extraidos", F.col("metadados_extraidos").withField("envolvidos", people))


def translated(hearings: DataFrame, translations: DataFrame, size: int = 4) -> DataFrame:
    """Texts of valid opinions replaced by translations (source, target); a text without one is an error. The lookup joins distinct
    texts, so each is translated once however often it occurs."""
    o = hearings.select("id", F.explode("metadados_extraidos.envolvidos").alias("p")).select("id", F.explode("p.opinioes").alias("o"))
    texts = o.where(valid(F.col("o"), size)).select("id", F.explode(F.concat(F.array("o.opiniao"), F.col("o.chunks_proximos"))).alias("source")).distinct()
    known = translations.select("source", F.struct("target").alias("t"))
    target = F.when(F.col("t").isNotNull(), F.col("t.target")).otherwise(F.raise_error(F.concat(F.lit("no translation of: "), F.col("source"))))
    lookup = texts.join(known, "source", "left").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("source", target.alias("target")))).alias("__t"))
    joined = hearings.join(lookup, "id", "left")

    def change(x: Column) -> Column:
        new = x.withField("opiniao", F.element_at("__t", x["opiniao"])).withField("chunks_proximos", F.transform(x["chunks_proximos"], lambda c: F.element_at("__t", c)))
        return F.when(valid(x, size), new).otherwise(x)

    return mapped(joined, change).drop("__t")


def translated_json(lines: DataFrame, translations: DataFrame, schema: str, column: str = "value", size: int = 4) -> DataFrame:
    """JSON lines of hearings with the texts of valid opinions replaced by translations (source, target) and everything else, known to the
    schema or not, as it is: only text leaves of the JSON change. A text without a translation is an error."""
    parsed = lines.select(F.col(column).alias("__line"), F.from_json(column, schema).alias("__h"))
    rows = parsed.withColumn("__k", F.sha2("__line", 256))
    o = rows.select("__k", F.explode("__h.metadados_extraidos.envolvidos").alias("p")).select("__k", F.explode("p.opinioes").alias("o"))
    texts = o.where(valid(F.col("o"), size)).select("__k", F.explode(F.concat(F.array("o.opiniao"), F.col("o.chunks_proximos"))).alias("source")).distinct()
    known = translations.select("source", F.struct("target").alias("t"))
    target = F.when(F.col("t").isNotNull(), F.col("t.target")).otherwise(F.raise_error(F.concat(F.lit("no translation of: "), F.col("source"))))
    lookup = texts.join(known, "source", "left").groupBy("__k").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", target.alias("target"))))).alias("__t"))

    @F.pandas_udf(T.StringType())
    def rewritten(line: pd.Series, table: pd.Series) -> pd.Series:
        return pd.Series([_rewritten(x, t, size) for x, t in zip(line, table, strict=True)])

    return rows.join(lookup, "__k", "left").select(rewritten("__line", F.col("__t")).alias(column))


def _rewritten(line: str | None, table: str | None, size: int) -> str | None:
    if line is None or table is None:
        return line
    new, hearing = json.loads(table), json.loads(line)
    for person in (hearing.get("metadados_extraidos") or {}).get("envolvidos") or []:
        for x in person.get("opinioes") or []:
            texts = [x.get("opiniao"), *(x.get("chunks_proximos") or [])]
            if len(texts) == size + 1 and all(isinstance(t, str) and t.strip() for t in texts):
                x["opiniao"], x["chunks_proximos"] = new[texts[0]], [new[t] for t in texts[1:]]
    return json.dumps(hearing, ensure_ascii=False)


def skeleton(hearings: DataFrame, size: int = 4) -> DataFrame:
    """(id, hash) of hearings without what a translation may change."""

    def change(x: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.when(valid(x, size), x.withField("opiniao", none).withField("chunks_proximos", F.transform(x["chunks_proximos"], lambda _: none))).otherwise(x)

    return mapped(hearings, change).select("id", F.xxhash64(F.to_json(F.struct("metadados_extraidos"))).alias("skeleton"))


def structure_mismatches(source: DataFrame, target: DataFrame, size: int = 4) -> DataFrame:
    """Ids of hearings that are on one side only or differ in more than translated texts."""
    a, b = skeleton(source, size), skeleton(target, size).withColumnRenamed("skeleton", "other")
    return a.join(b, "id", "full_outer").where(~F.col("skeleton").eqNullSafe(F.col("other"))).select("id")


def masked_mismatches(source: DataFrame, target: DataFrame, key: str, mask: str, slots: list[str]) -> DataFrame:
    """One row: how often masks differ, valid slots are lost, or masked slots change."""
    a = source.select(key, F.col(mask).alias("ma"), *[F.col(s).alias(f"a_{s}") for s in slots])
    b = target.select(key, F.col(mask).alias("mb"), *[F.col(s).alias(f"b_{s}") for s in slots])
    j = a.join(b, key)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    lost = sum((F.when(F.get("ma", F.lit(i)) & blank(f"b_{s}"), 1).otherwise(0) for i, s in enumerate(slots)), F.lit(0))
    changed = sum((F.when(~F.get("ma", F.lit(i)) & ~F.col(f"a_{s}").eqNullSafe(F.col(f"b_{s}")), 1).otherwise(0) for i, s in enumerate(slots)), F.lit(0))
    return j.agg(n(~F.col("ma").eqNullSafe(F.col("mb"))).alias("mask_mismatch"), n(lost).alias("lost_slots"), n(changed).alias("masked_slot_changes"))
