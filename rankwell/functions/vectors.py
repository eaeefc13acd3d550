"""Cosine similarity and vector checks on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankwell.functions.text import clamp, is_finite, let


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    """Euclidean length in double precision."""
    return let(v.cast("array<double>"), lambda x: F.sqrt(_dot(x, x)))


def cosine_percent(
    a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None
) -> Column:
    """Cosine as 0 to 100, null where it is undefined: missing, empty, unequal width, zero.

    Pass the lengths when they are already stored with the vectors; only the product is then
    left to compute for each pair.
    """
    norm_a = norm(a) if norm_a is None else norm_a
    norm_b = norm(b) if norm_b is None else norm_b
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm_a != 0) & (norm_b != 0)
    dot = _dot(a.cast("array<double>"), b.cast("array<double>"))
    cosine = F.when(usable, dot / (norm_a * norm_b))
    return let(cosine, lambda c: F.when(is_finite(c), clamp(c * 100, 0, 100)))


def is_usable_vector(v: Column, width: int) -> Column:
    """Right width and only finite numbers."""
    ok = (F.size(v) == width) & F.forall(v, lambda x: F.coalesce(is_finite(x), F.lit(False)))
    return F.coalesce(ok, F.lit(False))
