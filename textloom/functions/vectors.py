"""Dense vectors as arrays of doubles; sums run from left to right."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(c: Column) -> Column:
    """As an array of doubles."""
    return c.cast("array<double>")


def usable(c: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` components, all numbers, not all zero."""
    return F.coalesce((F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x)) & F.exists(c, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Sum of products."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(d != 0, d))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def centered(v: Column, mean: Column) -> Column:
    """Each component less its mean."""
    return F.zip_with(v, mean, lambda x, m: x - m)


def standardized(v: Column, mean: Column, std: Column) -> Column:
    """Centered and divided by the standard deviation; 0 where that is 0."""
    return F.zip_with(centered(v, mean), std, lambda x, s: F.when(s == 0, F.lit(0.0)).otherwise(x / F.when(s != 0, s)))


def transformed(name: str, v: Column, mean: Column, std: Column) -> Column:
    """``center``, ``standardize`` or, for any other name, unchanged; case does not matter."""
    return {"center": lambda: centered(v, mean), "standardize": lambda: standardized(v, mean, std)}.get(name.lower(), lambda: v)()


def alike(a: Column, b: Column, floor: float = 0.995) -> Column:
    """Whether two vectors have at least a cosine of ``floor``."""
    return cosine(a, b) >= floor


def within(a: Column, b: Column, most: float) -> Column:
    """Whether no component differs by more than ``most``."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= most)
