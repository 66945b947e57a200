"""An embedding that needs no model: hashed term frequencies, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import distinctive


def hashed(text: Column, dim: int = 64) -> Column:
    """Distinctive tokens counted in ``dim`` buckets, as floats of length 1 (zeros for no tokens)."""
    buckets = F.transform(distinctive(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(counts, lambda x: (x / norm).cast("float"))).otherwise(F.array_repeat(F.lit(0.0).cast("float"), dim))
