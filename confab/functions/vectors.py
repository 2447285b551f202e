"""Vector columns: JVM-side arithmetic on ARRAY columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision; NULL where the widths differ."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                        F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(a: Column | str) -> Column:
    """L2-normalised copy; the length is floored at 1e-8."""
    a = F.col(a) if isinstance(a, str) else a
    # the one-element array makes the length a value that is computed once, not per component
    length = F.array(F.greatest(norm(a), F.lit(1e-8)))
    return F.transform(length, lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
