"""Vector arithmetic as columns over array<float> or array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def as_doubles(v) -> Column:
    return _col(v).cast("array<double>")


def dot(a, b) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 if either vector has no length."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` mentions it (lambdas aren't searched for repeats)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def l2_normalize(v) -> Column:
    """Scaled to length one; unchanged when shorter than 1e-12."""
    measured = bound(as_doubles(v), lambda u: F.struct(u.alias("v"), norm(u).alias("n")))
    return bound(measured, lambda s: F.when(s["n"] < 1e-12, s["v"]).otherwise(F.transform(s["v"], lambda x: x / s["n"])))


def truncate_normalize(v, dim: int) -> Column:
    return l2_normalize(F.slice(as_doubles(v), 1, dim))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def mean_pool(vectors, dim: int) -> Column:
    """Mean of an array of vectors: zeros for none."""

    def mean(own):
        total = F.aggregate(own, zeros(dim), lambda s, v: F.zip_with(s, as_doubles(v), lambda x, y: x + y))
        summed = bound(total, lambda t: F.struct(t.alias("t"), F.size(own).alias("n")))
        return F.when(own.isNull() | (F.size(own) == 0), zeros(dim)).otherwise(bound(summed, lambda s: F.transform(s["t"], lambda x: x / s["n"])))

    return bound(_col(vectors), mean)


def hybrid(text, structural, translational, text_dim: int, part_dim: int) -> Column:
    """Normalised text, mean structural and mean translational parts, joined and normalised again."""
    parts = [truncate_normalize(text, text_dim), l2_normalize(mean_pool(structural, part_dim)), l2_normalize(mean_pool(translational, part_dim))]
    return l2_normalize(F.concat(*parts))


def query_hybrid(text, text_dim: int, part_dim: int) -> Column:
    return l2_normalize(F.concat(truncate_normalize(text, text_dim), zeros(2 * part_dim)))
