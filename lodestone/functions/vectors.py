"""Vector columns: validity, scaled cosine, reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60


def valid(vector: Column, most: int = 2048) -> Column:
    """1 to ``most`` finite components, not all zero."""
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.size(vector).between(1, most) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, not once an element of the arrays inside."""
    return F.transform(F.array(value), use)[0]


def scaled(vector: Column) -> Column:
    """Divided by the largest magnitude, so that no product overflows."""
    return _bound(F.array_max(F.transform(vector, F.abs)), lambda top: F.transform(vector, lambda x: x / top))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_of_scaled(a: Column, norm_a: Column, b: Column, norm_b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b) / (norm_a * norm_b)))


def cosine(a: Column, b: Column) -> Column:
    """Of scaled vectors, clamped to [-1, 1]."""
    return _bound(F.struct(scaled(a).alias("a"), scaled(b).alias("b")), lambda s: cosine_of_scaled(s["a"], norm(s["a"]), s["b"], norm(s["b"])))


def fused(*ranks: Column, k: int = RRF_K) -> Column:
    """Reciprocal-rank fusion with equal weights; an absent rank adds nothing."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(1.0 / (k + r), F.lit(0.0))
    return out
