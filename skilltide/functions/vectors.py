"""Vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, bind, trigrams

STORED_DECIMALS = 6


def round_vector(c: Column | str, decimals: int = STORED_DECIMALS) -> Column:
    """Vectors are kept with six decimals, both stored and asked for."""
    return F.transform(_col(c), lambda x: F.round(x.cast("double"), decimals))


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(c: Column | str) -> Column:
    return F.sqrt(dot(c, c))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; NULL when a vector is missing or has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_normalize(c: Column | str, floor: float = 1e-12) -> Column:
    return bind(_col(c), lambda v: bind(F.greatest(norm(v), F.lit(floor)), lambda length:
                F.transform(v, lambda x: x.cast("double") / length)))


def hashed_trigram_vector(c: Column | str, dim: int = 64) -> Column:
    """Default text vector: trigram counts in md5 buckets, unit length.

    md5 rather than a Spark hash, so that a query can be embedded outside Spark too.
    """
    buckets = F.transform(trigrams(c), lambda t: F.conv(
        F.substring(F.md5(t.cast("binary")), 1, 6), 16, 10).cast("int") % dim)
    counts = bind(buckets, lambda bs: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.size(F.filter(bs, lambda b: b == i)).cast("double")))
    return F.transform(l2_normalize(counts), lambda x: x.cast("float"))
