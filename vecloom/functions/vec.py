"""Vector arithmetic on array<double> columns, as JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once; inside a lambda it would be evaluated for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column, eps: float = EPS) -> Column:
    """v / max(|v|, eps)."""
    return let(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(v, lambda x: x / n))


def l2_normalize_guarded(v: Column, least: float = 0.0) -> Column:
    """v / |v| where |v| > least, else v as it is."""
    return let(norm(v), lambda n: F.when(n > least, F.transform(v, lambda x: x / n)).otherwise(v))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity, whatever the norms."""
    return 1.0 - dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def unit_distance(a: Column, b: Column) -> Column:
    """Cosine distance of vectors known to have unit norm."""
    return 1.0 - dot(a, b)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def euclidean_of_cosine(d: Column) -> Column:
    """Euclidean distance of unit vectors at cosine distance d."""
    return F.sqrt(2.0 * F.greatest(d, F.lit(0.0)))


def cosine_of_euclidean(e: float) -> float:
    return e * e / 2


def running_centroid(c: Column, n: Column, v: Column) -> Column:
    """(c * n + v) / (n + 1), normalised."""
    return l2_normalize(F.zip_with(c, v, lambda x, y: (x * n + y) / (n + 1)))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, and never negative zero."""
    return F.round(c, digits) + F.lit(0.0)
