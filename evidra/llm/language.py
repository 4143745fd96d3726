"""Language identification by a bidirectional gated recurrent network over bytes.

Every text is read whole, in windows of WINDOW bytes that start from a zero state, so any number of windows of any texts
runs in step and memory is bounded. Both directions have one layer of HIDDEN gated recurrent units; at each byte their
states together give class probabilities, and a document's probabilities are the mean over its bytes. The network is
trained here, in numpy, by backpropagation through time with Adam, on windows of a bounded sample: about SAMPLE
documents of each language, WINDOWS_PER_DOC windows of each, drawn by hashes of the id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import filter_rows, held_out, labelled_sample, ship, text_slices

HIDDEN, WINDOW, BATCH = 16, 256, 2048
#: Of training: documents of a language, windows of a document, window length, batch, steps, learning rate.
SAMPLE, WINDOWS_PER_DOC, TRAIN_WINDOW, TRAIN_BATCH, STEPS, RATE = 1500, 2, 96, 256, 350, 0.02
UNKNOWN = "und"
#: Mean probability of the predicted language below which drop_unknown takes a text for none of the known languages.
LEAST = 0.4


@dataclass
class Model:
    """labels; for each direction the input table (3H, 256), recurrent (2H, H) and candidate (H, H) weights; output (L, 2H) and bias."""

    labels: list[str]
    params: dict[str, np.ndarray]


def _init(n_labels: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"E{d}"] = rng.normal(0, 0.3, (3 * HIDDEN, 256))
        p[f"U{d}"] = rng.normal(0, HIDDEN**-0.5, (2 * HIDDEN, HIDDEN))
        p[f"V{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, HIDDEN))
    p["W"] = rng.normal(0, 0.3, (n_labels, 2 * HIDDEN))
    p["b"] = np.zeros((n_labels, 1))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _step(p: dict, d: str, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New state, gates (update, reset), candidate, reset state. Gates are (1 + tanh a) / 2."""
    H = len(h)
    e = p[f"E{d}"].take(x, 1)
    g = p[f"U{d}"] @ h
    g += e[: 2 * H]
    np.tanh(g, out=g)
    g += 1
    g *= 0.5
    rh = g[H:] * h
    c = p[f"V{d}"] @ rh
    c += e[2 * H :]
    np.tanh(c, out=c)
    new = c - h
    new *= g[:H]
    new += h
    return new, g, c, rh


def position_probabilities(p: dict, x: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """(steps, labels, windows) class probabilities of bytes x (steps, windows); valid marks those before a window's end."""
    T, B = x.shape
    L = len(p["b"])
    out = np.empty((T, L, B), np.float32)
    h = np.zeros((HIDDEN, B), np.float32)
    for t in range(T):
        h = _step(p, "f", x[t], h)[0]
        out[t] = p["W"][:, :HIDDEN] @ h
    h = np.zeros((HIDDEN, B), np.float32)
    whole = valid.all(1)
    for t in range(T - 1, -1, -1):
        h = _step(p, "b", x[t], h)[0]
        if not whole[t]:
            h *= valid[t]
        out[t] += p["W"][:, HIDDEN:] @ h
    out += p["b"]
    out -= out.max(1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(1, keepdims=True)
    out *= valid[:, None, :]
    return out


def _gradients(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
    """Cross-entropy of every position of full windows x (steps, windows) with labels y, by backpropagation through time."""
    T, B = x.shape
    H = HIDDEN
    states, tape = {}, {}
    for d in "fb":
        order = range(T) if d == "f" else range(T - 1, -1, -1)
        h = np.zeros((H, B), np.float32)
        hs, kept = np.empty((T, H, B), np.float32), [None] * T
        for t in order:
            prev = h
            h, g, c, rh = _step(p, d, x[t], h)
            hs[t], kept[t] = h, (prev, g, c, rh)
        states[d], tape[d] = hs, kept
    both = np.concatenate([states["f"], states["b"]], 1)
    logits = np.einsum("lk,tkb->tlb", p["W"], both, optimize=True) + p["b"]
    logits -= logits.max(1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(1, keepdims=True)
    at = prob[np.arange(T)[:, None], y[None, :], np.arange(B)[None, :]]
    loss = float(-np.log(at + 1e-9).mean())
    prob[np.arange(T)[:, None], y[None, :], np.arange(B)[None, :]] -= 1
    prob /= T * B
    grad = {"W": np.einsum("tlb,tkb->lk", prob, both, optimize=True), "b": prob.sum((0, 2))[:, None]}
    down = np.einsum("lk,tlb->tkb", p["W"], prob, optimize=True)
    for k, d in enumerate("fb"):
        U, V = p[f"U{d}"], p[f"V{d}"]
        gU, gV = np.zeros_like(U), np.zeros_like(V)
        pre = np.empty((T, 3 * H, B), np.float32)
        dh = np.zeros((H, B), np.float32)
        for t in range(T - 1, -1, -1) if d == "f" else range(T):
            prev, g, c, rh = tape[d][t]
            dh = dh + down[t, k * H : (k + 1) * H]
            z, r = g[:H], g[H:]
            dc = dh * z * (1 - c * c)
            drh = V.T @ dc
            dg = np.concatenate([dh * (c - prev), drh * prev]) * (2 * g * (1 - g))
            gV += dc @ rh.T
            gU += dg @ prev.T
            pre[t, : 2 * H], pre[t, 2 * H :] = dg, dc
            dh = dh * (1 - z) + drh * r + U.T @ dg
        flat = x.ravel()
        grad[f"E{d}"] = np.stack([np.bincount(flat, pre[:, j].ravel(), 256) for j in range(3 * H)])
        grad[f"U{d}"], grad[f"V{d}"] = gU, gV
    return grad, loss


def train(windows: list[tuple[bytes, str]], steps: int = STEPS, seed: int = 7) -> Model | None:
    """A model from (bytes, label) windows; None if there are none. Languages are drawn evenly; windows shorter than
    TRAIN_WINDOW repeat themselves."""
    by: dict[str, list[bytes]] = {}
    for w, label in windows:
        if w:
            by.setdefault(label, []).append(w)
    if not by:
        return None
    labels = sorted(by)
    rng = np.random.default_rng(seed)
    pools = [np.stack([np.resize(np.frombuffer(w, np.uint8), TRAIN_WINDOW) for w in by[c]]) for c in labels]
    p = _init(len(labels), rng)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for i in range(1, steps + 1):
        y = rng.integers(0, len(labels), TRAIN_BATCH)
        x = np.stack([pools[c][rng.integers(0, len(pools[c]))] for c in y]).T
        grad, _ = _gradients(p, np.ascontiguousarray(x), y)
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grad.values())))
        rate = RATE * min(1.0, i / 20) * (1 - 0.9 * i / steps)
        for k, g in grad.items():
            g = (g * min(1.0, 1.0 / (norm + 1e-9))).astype(np.float32)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)).astype(np.float32)
    return Model(labels, p)


def document_probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, labels): the mean over all bytes of each document; zeros for empty ones."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(n), count)
    first = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=first[1:])
    start = offsets[doc] + (np.arange(len(doc)) - first[doc]) * WINDOW
    length = np.minimum(offsets[doc + 1] - start, WINDOW)
    order = np.argsort(-length, kind="stable")
    total = np.zeros((n, len(model.labels)))
    for a in range(0, len(order), BATCH):
        some = order[a : a + BATCH]
        steps = np.arange(int(length[some[0]]))[:, None]
        valid = steps < length[some]
        x = data[np.minimum(start[some] + steps, len(data) - 1)]
        pooled = position_probabilities(model.params, x, valid).sum(0, dtype=np.float64).T
        np.add.at(total, doc[some], pooled)
    return total / np.maximum(size, 1)[:, None]


_WINDOWS = pa.schema([("row_id", pa.int64()), ("label", pa.string()), ("window", pa.binary())])


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("row_id", "label"))
        out: list[list] = [[], [], []]
        for a, b, data, off in text_slices(batch, "text", 8 << 20):
            for i in range(b - a):
                raw = data[off[i] : off[i + 1]]
                for k in range(WINDOWS_PER_DOC):
                    at = zlib.crc32(f"{ids[a + i]}/{k}".encode()) % max(1, len(raw) - TRAIN_WINDOW + 1)
                    for c, v in zip(out, (ids[a + i], labels[a + i], raw[at : at + TRAIN_WINDOW].tobytes()), strict=True):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _WINDOWS, strict=True)], schema=_WINDOWS)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Learn from text and label of rows that are not held out, with non-null text and label."""
    ship(docs.sparkSession)
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).cast("long").alias("row_id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("label").isNotNull() & F.col("text").isNotNull() & F.col("row_id").isNotNull())
    got = labelled_sample(rows, "label", sample, "row_id").mapInArrow(_draw, "row_id long, label string, window binary").toPandas()
    got = got.sort_values(["label", "row_id", "window"], kind="stable")
    return train(list(zip((bytes(w) for w in got["window"]), got["label"], strict=True)))


_OUT = pa.schema([("row_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("row_id"))
            lettered = batch.column(batch.schema.get_field_index("lettered")).to_pylist()
            for a, b, data, off in text_slices(batch, "text", 1 << 20):
                if model is None:
                    names, score = [UNKNOWN] * (b - a), np.zeros(b - a)
                else:
                    p = document_probabilities(model, data, off)
                    best = p.argmax(1)
                    ok = np.array(lettered[a:b], bool)
                    names = [model.labels[k] if o else UNKNOWN for k, o in zip(best.tolist(), ok.tolist(), strict=True)]
                    score = np.clip(np.where(ok, p[np.arange(len(p)), best], 0.0), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(names, pa.string()), pa.array(score)], schema=_OUT)

    return run


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, lang_pred, score of every whole text. Null, empty and letterless texts: und, 0. Without a model (no
    labelled row): und, 0. Only the text is read for a prediction; ids may repeat or be null."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predictor(spark.sparkContext.broadcast(model)), "row_id long, lang_pred string, score double")


def drop_unknown(docs: DataFrame, model: Model | None, text_col: str = "text", languages: Sequence[str] | None = None, least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, whose predicted language is one of languages (none given: any that the model knows) with a score of
    least or more. Null, empty and letterless texts go, with or without a model; without a model all other texts stay, as nothing is
    predicted. Rows pass as they are: ids may repeat or be null."""
    spark = docs.sparkSession
    ship(spark)
    lettered = {"lettered": F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))}
    if model is None:
        return docs.where(lettered["lettered"])
    shared, wanted = spark.sparkContext.broadcast(model), None if languages is None else frozenset(languages)

    def judge(batch: pa.RecordBatch, text: str) -> np.ndarray:
        ok = np.array(batch.column(batch.schema.get_field_index("lettered")).to_pylist(), bool)
        model: Model = shared.value
        for a, b, data, off in text_slices(batch, text, 1 << 20):
            p = document_probabilities(model, data, off)
            best = p.argmax(1)
            ok[a:b] &= p[np.arange(len(p)), best] >= least
            if wanted is not None:
                ok[a:b] &= np.array([x in wanted for x in model.labels])[best]
        return ok

    return filter_rows(docs, text_col, lettered, judge)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, fit(docs)).withColumnRenamed("row_id", "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


ORACLES: dict[str, str] = {}
