"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

Words are runs of non-space bytes. Each word counts as itself in lower case and as its shape (upper, lower, digit classes
with runs folded, punctuation as it is; a word equal to the one before has the shape "again"), so unseen words still
tell noise from prose. Features are the 1- and 2-grams of words and the 1- to 3-grams of shapes, hashed to 2^BITS
slots; a slot's value is its share of the n-grams of its family, times SCALE. Fitted on about SAMPLE labelled rows of each label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import textvec as tv
from evidra.llm.common import held_out, labelled_sample, ship, text_slices

BITS, SCALE, SAMPLE, EPOCHS = 18, 10.0, 1500, 4
#: Of the leader: learning rate, its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-3
FAMILIES = (("word", 1), ("word", 2), ("shape", 1), ("shape", 2), ("shape", 3))
_U = np.uint64
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x41:0x5B] = 0x41
_CLASS[0x61:0x7B] = 0x61
_CLASS[0x80:] = 0x61
_CLASS[0x30:0x3A] = 0x30


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, values and the document of every n-gram (slots may repeat)."""
    s, e, first = tv.words(data, offsets)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64)
    word = tv.word_hashes(tv.LOWER[data], s, e)
    cls = _CLASS[data]
    keep = tv.NOT_SPACE[data]
    keep[1:] &= (cls[1:] != cls[:-1]) | ~tv.NOT_SPACE[data[:-1]]
    keep[s] = True
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    shape = tv.word_hashes(cls[keep], place[s], place[e])
    again = np.zeros(len(s), bool)
    again[1:] = word[1:] == word[:-1]
    again[first[:-1][first[:-1] < len(s)]] = False
    shape[again] = _U(0xA6A1)
    slots, values, owners = [], [], []
    for salt, (kind, k) in enumerate(FAMILIES, 1):
        h, begin = tv.shingle_hashes(word if kind == "word" else shape, first, k)
        count = np.diff(begin)
        slots.append((tv.mix(h + _U(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> _U(64 - BITS)).astype(np.int64))
        owners.append(np.repeat(np.arange(len(count)), count))
        values.append(np.repeat(SCALE / np.maximum(count, 1), count).astype(np.float32))
    return np.concatenate(slots), np.concatenate(values), np.concatenate(owners)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = 11) -> tuple[np.ndarray, float] | None:
    """Weights and bias from (slots, values, label) rows. The last slot of the state is the bias. Labels weigh the same
    in sum. None if there are no rows."""
    if not rows:
        return None
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    share = np.mean([y for _, _, y in rows])
    weight = (0.5 / max(1 - share, 1e-9), 0.5 / max(share, 1e-9)) if 0 < share < 1 else (1.0, 1.0)
    rng = np.random.default_rng(seed)

    def leader(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x, y = rows[k]
            i, x = np.append(i, size), np.append(x, 1.0)
            w = leader(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x * weight[y]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = leader(np.arange(size + 1))
    return w[:-1].astype(np.float32), float(w[-1])


_ROW = pa.schema([("row_id", pa.int64()), ("label", pa.int32()), ("slots", pa.binary()), ("values", pa.binary())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("row_id", "label"))
        for a, b, data, off in text_slices(batch, "text", 1 << 20):
            slot, value, owner = features(data, off)
            at = np.argsort(owner, kind="stable")
            slot, value, edge = slot[at], value[at], np.searchsorted(owner[at], np.arange(b - a + 1))
            cols: list[list] = [[], [], [], []]
            for i in range(b - a):
                u, back = np.unique(slot[edge[i] : edge[i + 1]], return_inverse=True)
                v = np.bincount(back, value[edge[i] : edge[i + 1]], len(u))
                for c, x in zip(cols, (ids[a + i], labels[a + i], u.astype(np.int32).tobytes(), v.astype(np.float32).tobytes()), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROW, strict=True)], schema=_ROW)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """Learn from labelled rows that are not held out; labels other than 0 and 1, null ids and ids with both labels are left out."""
    ship(docs.sparkSession)
    known = labels.where(~held_out(id_col)).select(F.col(id_col).cast("long").alias("row_id"), F.col(label_col).cast("int").alias("label"))
    known = labelled_sample(known.where(F.col("label").isin(0, 1) & F.col("row_id").isNotNull()).groupBy("row_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other"), "label", sample, "row_id")
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), "row_id")
    got = rows.select("row_id", "label", "text").mapInArrow(_extract, "row_id long, label int, slots binary, values binary").toPandas().sort_values("row_id", kind="stable")
    return ftrl([(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32).astype(float), int(y)) for s, v, y in zip(got["slots"], got["values"], got["label"], strict=True)])


_OUT = pa.schema([("row_id", pa.int64()), ("score", pa.float64())])


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value or (np.zeros(1 << BITS, np.float32), 0.0)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("row_id"))
            for a, b, data, off in text_slices(batch, "text", 1 << 20):
                slot, value, owner = features(data, off)
                dot = np.bincount(owner, weights[slot] * value, b - a) + bias
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(dot, -30, 30))))], schema=_OUT)

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id and score of every whole text. Null and wordless texts get the bias alone; without a model all get 0.5."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), "row_id long, score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).withColumnRenamed("row_id", "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


ORACLES: dict[str, str] = {}
