"""Vector functions on array columns; elements are widened to double and added in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """v over its norm; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Zero where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def truncated(v: Column, n: int) -> Column:
    """The first n dimensions at unit length; shorter vectors are an error, never padded."""
    whole = F.when(F.size(v) >= n, v).otherwise(F.raise_error(F.lit(f"vector has fewer than {n} dimensions")).cast("array<double>"))
    return unit(F.slice(whole, 1, n))


def native(v: Column, n: int | None = None) -> Column:
    """v at unit length; with n, a vector of another size is an error."""
    if n is None:
        return unit(v)
    return unit(F.when(F.size(v) == n, v).otherwise(F.raise_error(F.lit(f"vector doesn't have {n} dimensions")).cast("array<double>")))


def transformed(v: Column, variant: str, n: int | None = None) -> Column:
    """native_l2 or truncate_l2; the second needs n, and no vector is ever padded."""
    if variant not in ("native_l2", "truncate_l2"):
        raise ValueError(f"unknown variant {variant!r}")
    if variant == "truncate_l2" and n is None:
        raise ValueError("truncate_l2 needs a number of dimensions")
    return native(v, n) if variant == "native_l2" else truncated(v, n)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
