"""Pooling heads over bags of evidence: mean, max, gated attention and set attention over a fixed number of masked slots.

A bag is a row with one flat array of slots times width numbers and a mask. Heads are parameters in numpy, small and of a fixed size, and reach the tasks by
broadcast; a task pools some thousand bags at once with matrix products. An invalid slot changes nothing, whatever it holds; a bag without a valid slot is
an error. The order of slots changes no pooled value, only the order of the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOTS = 4
#: Numbers of bags that are pooled at once in a task.
CELLS = 1 << 21


def bags(df: DataFrame, keys: list[str], slot: str, vector: str, valid: Column, width: int, slots: int = SLOTS) -> DataFrame:
    """keys, vectors (flat, slots x width) and mask of rows that each hold one slot. Missing slots, null vectors and rows that are not valid are masked and hold
    zeros; a vector of another width is an error, a slot number outside of 0 to slots - 1 too. Of rows with the same slot the first by its vector is
    taken."""
    number = F.col(slot).cast("int")
    checked = F.when((F.size(vector) == width) & number.between(0, slots - 1), F.transform(vector, lambda x: x.cast("double"))).otherwise(F.raise_error(F.lit(f"a slot of {width} numbers below {slots} is asked for")).cast("array<double>"))
    rows = df.where(F.col(vector).isNotNull() & F.coalesce(valid, F.lit(False))).select(*keys, number.alias("s"), checked.alias("v"))
    one = rows.groupBy(*keys, "s").agg(F.min("v").alias("v"))
    held = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("s", "v"))).alias("m"))
    at = F.sequence(F.lit(0), F.lit(slots - 1))
    zeros = F.array_repeat(F.lit(0.0), width)
    return held.select(*keys, F.flatten(F.transform(at, lambda i: F.coalesce(F.try_element_at("m", i), zeros))).alias("vectors"), F.transform(at, lambda i: F.map_contains_key("m", i)).alias("mask"))


def _softmax(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Over the last axis, zero where mask is false; all zero where nothing is valid."""
    x = np.where(mask, x, -np.inf)
    top = x.max(axis=-1, keepdims=True)
    e = np.where(mask, np.exp(x - np.where(np.isfinite(top), top, 0)), 0.0)
    return e / np.maximum(e.sum(axis=-1, keepdims=True), np.finfo(float).tiny)


def _gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1 + np.fromiter(map(math.erf, (x / math.sqrt(2)).ravel()), float, x.size).reshape(x.shape))


def _norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + 1e-5) * scale + shift


@dataclass
class Head:
    """kind is mean, max, gated_attention or set_transformer; values are its arrays by name (see shapes), lanes the number of attention lanes."""

    kind: str
    values: dict[str, np.ndarray] = field(default_factory=dict)
    lanes: int = 1

    @staticmethod
    def shapes(kind: str, width: int, attention: int = 8, hidden: int | None = None) -> dict[str, tuple[int, ...]]:
        """Names and shapes of a head's arrays for inputs of a width. score and score_shift make the logit of what is pooled."""
        out: dict[str, tuple[int, ...]] = {"score": (width,), "score_shift": (1,)}
        if kind == "gated_attention":
            out |= {"tanh": (attention, width), "tanh_shift": (attention,), "gate": (attention, width), "gate_shift": (attention,), "weigh": (attention,)}
        elif kind == "set_transformer":
            hidden = hidden or width
            for block in ("set", "pool"):
                for part in ("query", "key", "value", "out"):
                    out |= {f"{block}_{part}": (width, width), f"{block}_{part}_shift": (width,)}
                out |= {f"{block}_{n}": (width,) for n in ("norm1", "norm1_shift", "norm2", "norm2_shift")}
                out |= {f"{block}_wide": (hidden, width), f"{block}_wide_shift": (hidden,), f"{block}_narrow": (width, hidden), f"{block}_narrow_shift": (width,)}
            out["seed"] = (1, width)
        elif kind not in ("mean", "max"):
            raise ValueError(f"unknown head: {kind}")
        return out

    @classmethod
    def drawn(cls, kind: str, width: int, seed: int = 0, lanes: int = 1, **sizes: int) -> Head:
        """A head with small random values; scales of norms are one."""
        rng = np.random.default_rng(seed)
        values = {n: (np.ones(s) if n.endswith(("norm1", "norm2")) else rng.normal(size=s) / math.sqrt(width)) for n, s in cls.shapes(kind, width, **sizes).items()}
        return cls(kind, values, lanes)

    def pooled(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bags x width, bags x slots): pooled vectors and slot weights of x (bags x slots x width)."""
        if not mask.any(axis=1).all():
            raise ValueError("a bag without a valid slot")
        x = np.where(mask[:, :, None], x, 0.0)
        if self.kind == "mean":
            w = mask / mask.sum(axis=1, keepdims=True)
        elif self.kind == "max":
            low = np.where(mask[:, :, None], x, -np.inf)
            w = (low.argmax(axis=1)[:, None, :] == np.arange(x.shape[1])[None, :, None]).mean(axis=2)
            return low.max(axis=1), w
        elif self.kind == "gated_attention":
            v = self.values
            gate = 1 / (1 + np.exp(-(x @ v["gate"].T + v["gate_shift"])))
            w = _softmax((np.tanh(x @ v["tanh"].T + v["tanh_shift"]) * gate) @ v["weigh"], mask)
        else:
            inner, _ = self._attend("set", x, x, mask)
            inner = np.where(mask[:, :, None], inner, 0.0)
            seeds = np.broadcast_to(self.values["seed"], (len(x), *self.values["seed"].shape))
            out, w = self._attend("pool", seeds, inner, mask)
            return out[:, 0], w[:, 0]
        return np.einsum("bs,bsd->bd", w, x), w

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.values["score"] + self.values["score_shift"][0]

    def _attend(self, block: str, asks: np.ndarray, holds: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention of asks over the valid slots of holds in several lanes, added to asks and normed, then a widened layer likewise; and the mean of the
        lanes' weights."""
        v = self.values
        split = lambda y: y.reshape(*y.shape[:2], self.lanes, -1).transpose(0, 2, 1, 3)
        q, k, c = (split(y @ v[f"{block}_{n}"].T + v[f"{block}_{n}_shift"]) for n, y in (("query", asks), ("key", holds), ("value", holds)))
        w = _softmax(q @ k.transpose(0, 1, 3, 2) / math.sqrt(q.shape[-1]), mask[:, None, None, :])
        joined = (w @ c).transpose(0, 2, 1, 3).reshape(asks.shape)
        h = _norm(asks + joined @ v[f"{block}_out"].T + v[f"{block}_out_shift"], v[f"{block}_norm1"], v[f"{block}_norm1_shift"])
        wide = _gelu(h @ v[f"{block}_wide"].T + v[f"{block}_wide_shift"])
        return _norm(h + wide @ v[f"{block}_narrow"].T + v[f"{block}_narrow_shift"], v[f"{block}_norm2"], v[f"{block}_norm2_shift"]), w.mean(axis=1)


def pool(df: DataFrame, heads: dict[str, Head], keys: list[str], slots: int = SLOTS, vectors: str = "vectors", mask: str = "mask") -> DataFrame:
    """keys, head, pooled, weights (one a slot, 0 where it is masked, 1 in sum) and logit, one row for each bag and named head; df is read once for all of them."""
    shared = df.sparkSession.sparkContext.broadcast(heads)
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("head", T.StringType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("pooled", "weights")), T.StructField("logit", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            width = len(whole.column(len(keys)).flatten()) // max(whole.num_rows * slots, 1)
            step = max(1, CELLS // max(1, slots * width))
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                x = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, slots, width)
                m = batch.column(len(keys) + 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, slots).astype(bool)
                for name, head in shared.value.items():
                    p, w = head.pooled(x, m)
                    lists = [pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], pa.array(y.ravel())) for y in (p, w)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array([name] * batch.num_rows), *lists, pa.array(head.logits(p))], names=schema.names)

    return df.select(*keys, F.transform(vectors, lambda v: v.cast("double")).alias("vectors"), mask).mapInArrow(run, schema)
