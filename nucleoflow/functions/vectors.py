"""Arithmetic on packed ARRAY<DOUBLE> columns, kept inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A column used inside a lambda is otherwise merged into it by the optimizer
    and computed again for every element.
    """
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sum_squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def mean(v: Column) -> Column:
    return let(v, lambda w: total(w) / F.size(w))


def centred(v: Column) -> Column:
    return let(v, lambda w: let(total(w) / F.size(w), lambda m: F.transform(w, lambda x: x - m)))


def unit(v: Column) -> Column:
    """Centred and scaled to length one; a constant row becomes zeros."""

    def scale(c: Column) -> Column:
        norm = F.sqrt(sum_squares(c))
        return let(
            F.when(norm > 1e-12, norm).otherwise(F.lit(1.0)),
            lambda n: F.transform(c, lambda x: x / n),
        )

    return let(centred(v), scale)


def sample_variance(v: Column) -> Column:
    """Two-pass variance with n - 1; NULL for fewer than two entries."""
    return let(centred(v), lambda c: sum_squares(c) / F.nullif(F.size(c) - 1, F.lit(0)))


def standardized(v: Column, limit: float | None, ddof: int = 1) -> Column:
    """Row z-score, clipped to +-limit; a constant row becomes zeros."""

    def clip(z: Column) -> Column:
        return z if limit is None else F.greatest(F.lit(-limit), F.least(F.lit(limit), z))

    def scale(c: Column) -> Column:
        sd = F.sqrt(sum_squares(c) / (F.size(c) - ddof))
        return let(
            F.when(sd > 0, sd).otherwise(F.lit(1.0)),
            lambda n: F.transform(c, lambda x: clip(x / n)),
        )

    return let(centred(v), scale)


def element_means(vec: str, size: int) -> list[Column]:
    """Per-position means of an array column, usable in one ``agg``."""
    return [F.avg(F.col(vec)[i]) for i in range(size)]


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")
