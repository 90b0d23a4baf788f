"""Vector expressions on ``ARRAY<FLOAT|DOUBLE>`` columns (V2, V9).

All arithmetic is in DOUBLE and stays JVM-side (higher-order functions inside
whole-stage codegen); no ``VectorUDT`` round trips.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(_d(v), lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def l2_normalize(v: Column) -> Column:
    """V2: v / ||v||; a zero vector gives null (the reference yields NaN).

    Pass a column reference: the norm is part of the lambda, so a computed
    ``v`` would be re-evaluated per element (select it as a column first)."""
    n = norm(v)
    return F.when(n > 0, F.transform(_d(v), lambda x: x / n))


def euclidean(a: Column, b: Column) -> Column:
    """V9: Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda acc, x: acc + x))


def cosine(a: Column, b: Column) -> Column:
    """V9: cosine similarity (null when either vector is zero)."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def append(v: Column, *xs: Column) -> Column:
    """Append scalar features to a vector (V4, V5)."""
    return F.concat(_d(v), F.array(*[x.cast("double") for x in xs]))
