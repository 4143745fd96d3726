"""Scalar expressions: everything here is a Column, so plans stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least double above 1: a threshold that no score in [0, 1] reaches.
ABOVE_ONE = 1.0000000000000002


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def clip(x: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(_c(x), F.lit(high)), F.lit(low))


def log_loss(label: Column | str, score: Column | str, eps: float = 1e-6) -> Column:
    p = clip(score, eps, 1 - eps)
    y = _c(label).cast("double")
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def same_float(a: Column | str, b: Column | str, rel: float = 1e-6, tol: float = 1e-6) -> Column:
    """Equal within tolerance; two nulls or two NaN are equal, one is not."""
    a, b = _c(a), _c(b)
    none_a, none_b = a.isNull() | F.isnan(a), b.isNull() | F.isnan(b)
    close = F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(tol))
    return F.when(none_a | none_b, none_a & none_b).otherwise(close)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays in double."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays, 0 if either has no length. Exact up to its root and quotient if the numbers are whole."""
    return safe_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def unit(a: Column | str, tol: float = 2e-3) -> Column:
    """Whether a vector is finite and of length 1 within tol."""
    return F.forall(_c(a), lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.abs(norm(a) - 1) <= tol)


def overlap(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    """Characters that the half-open ranges [a, b) and [c, d) share; touching shares none."""
    return F.greatest(F.lit(0), F.least(_c(b), _c(d)) - F.greatest(_c(a), _c(c)))


def clamp_span(start: Column | str, end: Column | str, length: Column | str) -> Column:
    """The span inside [0, length] as a struct, null if empty or malformed."""
    s, e = (F.greatest(F.lit(0), F.least(F.expr(f"try_cast({x} AS INT)") if isinstance(x, str) else x.try_cast("int"), _c(length).cast("int"))) for x in (start, end))
    return F.when(e > s, F.struct(s.alias("start"), e.alias("end")))


def padded_slots(slots: Column | str, empty: Column, size: int = 4) -> Column:
    """An array of exactly size slots: the given ones, then empty ones."""
    slots = _c(slots)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.get(slots, i), empty))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Similarity of two arrays as sets; 0 if both are empty."""
    return safe_divide(F.size(F.array_intersect(_c(a), _c(b))), F.size(F.array_union(_c(a), _c(b))))


def reasons(sep: str = ";", **tests: Column) -> Column:
    """Names of the tests that hold, in order, joined; an empty string if none does."""
    return F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()])), sep)


def flag(x: Column | str) -> Column:
    """true/false/1/0 in any case and with blanks around as boolean; anything else is an error."""
    t = F.lower(F.trim(_c(x).cast("string")))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False).when(t.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), t)).cast("boolean"))


def binary_label(x: Column | str) -> Column:
    """A label given as boolean, 0/1 or 0.0/1.0 as int; anything else is an error."""
    v = _c(x).cast("double")
    return F.when(v.isin(0.0, 1.0), v.cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a binary label: "), F.coalesce(_c(x).cast("string"), F.lit("null")))).cast("int"))


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests)
