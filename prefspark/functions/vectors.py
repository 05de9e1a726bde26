"""Vector expressions on ``ARRAY<FLOAT|DOUBLE>`` columns (B1, B5 and helpers).

All arithmetic is done in double.  These are built-in higher-order functions, so
they stay in the JVM; bulk scoring of many pairs goes through the blocked kNN
operator instead (one matrix product per block).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Inner product; NULL when lengths differ (use ``cosine`` for the checked form)."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """B1: cosine similarity; error on unequal length, 0 when either norm is 0."""
    a, b = _c(a), _c(b)
    na, nb = norm(a), norm(b)
    return F.when(
        F.size(a) != F.size(b),
        F.raise_error(F.lit("Embeddings must have the same dimension")).cast("double"),
    ).otherwise(F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb)))


def l2_normalise(v, as_float: bool = True) -> Column:
    """Divide by the row norm; a zero norm divides by 1."""
    v = _c(v)
    n = norm(v)
    out = F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))
    return F.transform(out, lambda x: x.cast("float")) if as_float else out
