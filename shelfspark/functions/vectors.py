"""Dense-vector Column functions over ``ARRAY<FLOAT|DOUBLE>`` (array HOFs, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column | str) -> Column:
    """Unit vector (a zero vector stays zero).

    The norm is evaluated once per row: it enters the lambda through
    ``array_repeat`` instead of being captured (a captured expression is
    re-evaluated for every element).
    """
    a = _c(a)
    n = F.array_repeat(norm(a), F.size(a))
    return F.zip_with(a, n, lambda x, m: F.when(m > 0, x.cast("double") / m).otherwise(F.lit(0.0)))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """dot(a, b) / (|a|·|b|); null when either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    diffs = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) ** 2)
    return F.sqrt(F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x))
