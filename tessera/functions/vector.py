"""Column expressions on arrays of doubles and on grid positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with lengths clamped from below, so zero vectors give 0."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-8)) * F.greatest(norm(b), F.lit(1e-8)))


def shift(a: Column, n: Column) -> Column:
    """Cyclic shift to the left."""
    size = F.size(a)
    k = F.pmod(n, size).cast("int")
    return F.concat(F.slice(a, k + 1, size - k), F.slice(a, F.lit(1), k))


def r6(c: Column) -> Column:
    """To the nearest millionth by floating-point steps that any engine repeats, without a negative zero.

    The first step takes off the noise of sums in another order, which would tell at halves."""
    return F.floor(F.round(c, 11) * 1e6 + 0.5) / 1e6


def on_border(i: Column, n: Column) -> Column:
    return (i == 0) | (i == n - 1)


def piece_type(row: Column, col: Column, n_rows: Column, n_cols: Column) -> Column:
    """corner, edge or interior, from the place in the grid."""
    r, c = on_border(row, n_rows), on_border(col, n_cols)
    return F.when(r & c, "corner").when(r | c, "edge").otherwise("interior")


def expected_flats(kind: Column) -> Column:
    return F.when(kind == "corner", 2).when(kind == "edge", 1).otherwise(0).cast("long")


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "high").when(confidence >= 0.55, "medium").otherwise("low")
