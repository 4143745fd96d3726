"""Model contracts and offline stand-ins: a text encoder, a translator, an entailment scorer, as Arrow functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions.text import let


def mock_encoder(dimension: int = 32, prefix: str = "") -> Callable[[Column], Column]:
    """Unit vectors that depend on nothing but the text."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        def one(t: str) -> np.ndarray:
            v = np.random.default_rng(int.from_bytes(hashlib.sha256((prefix + (t or "")).encode()).digest()[:8], "big")).standard_normal(dimension)
            return (v / np.linalg.norm(v)).astype(np.float32)

        return texts.map(one)

    return encode


def hashed_bag(tokens: Column) -> Column:
    """Counts of tokens by the first hex digit of their md5: 16 whole numbers, in the JVM."""
    digits = F.array_join(F.transform(tokens, lambda t: F.substring(F.md5(t), 1, 1)), "")
    kinds = [F.lit(d) for d in "0123456789abcdef"]
    return let(digits, lambda s: F.array(*[(F.length(s) - F.length(F.replace(s, d, F.lit("")))).cast("double") for d in kinds]))


def fake_translator(mark: str = "pt:") -> Callable[[Column], Column]:
    return lambda text: F.concat(F.lit(mark), text)


def max_entailment(scores: Column, mask: Column) -> Column:
    """Support of a claim: the largest entailment over valid slots, null if there is none; the hallucination score is 1 less it."""
    valid = F.filter(F.arrays_zip(scores.alias("s"), mask.alias("m")), lambda x: x["m"])
    return F.array_max(F.transform(valid, lambda x: x["s"]))


def masked_mean(vectors: Column, mask: Column, dimension: int) -> Column:
    """Mean of the valid vectors of a bag, element by element."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"]), lambda x: x["v"])
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.try_divide(F.aggregate(kept, F.lit(0.0), lambda s, v: s + F.get(v, i)), F.size(kept).cast("double")))
