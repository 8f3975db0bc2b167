"""Vector and hash expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, z: s + z)


def l2_sq(a: str, b: str) -> Column:
    """Squared Euclidean distance, summed left to right in doubles; null where lengths differ or a part is null."""
    return _fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def inner_product(a: str, b: str) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: str, b: str) -> Column:
    return inner_product(a, b) / F.sqrt(inner_product(a, a) * inner_product(b, b))


def wang_hash(x: Column) -> Column:
    """Thomas Wang's 32-bit integer mix on a BIGINT; no step leaves 63 bits."""
    m = F.lit(4294967295)
    x = (x.bitwiseXOR(F.lit(61)).bitwiseXOR(F.shiftright(x, 16)) * 9).bitwiseAND(m)
    x = x.bitwiseXOR(F.shiftright(x, 4))
    x = (x * 668265261).bitwiseAND(m)
    return x.bitwiseXOR(F.shiftright(x, 15))
