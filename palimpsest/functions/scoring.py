"""Scores: recency, importance, density, fusion, cosine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K, BOOST = 60, 0.5 * 0.05
#: Half-lives in days by kind; any other has DEFAULT.
HALF_LIFE, DEFAULT_HALF_LIFE, NEUTRAL = {"profile": 180, "tools": 180, "project": 30, "general": 60}, 60, 5


def parse_time(text: Column) -> Column:
    """ISO 8601; ``Z`` and naive times are UTC, bad ones null."""
    return F.try_to_timestamp(text)


def importance_factor(importance: Column) -> Column:
    value = F.coalesce(importance.try_cast("double").try_cast("int"), F.lit(NEUTRAL))
    return F.greatest(F.lit(1), F.least(F.lit(10), value)) / F.lit(float(NEUTRAL))


def half_life(path: Column) -> Column:
    out = F.lit(DEFAULT_HALF_LIFE)
    for kind, days in HALF_LIFE.items():
        out = F.when(F.startswith(path, F.lit(kind + "/")), days).otherwise(out)
    return out


def recency_factor(path: Column, seen: Column, now: Column) -> Column:
    """exp(-ln 2 * age / half-life); future times count as now, and none as fresh."""
    hours = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(seen)) / 3.6e9)
    return F.coalesce(F.exp(F.lit(-math.log(2)) * hours / (half_life(path) * 24)), F.lit(1.0))


def last_seen() -> Column:
    return F.coalesce(*[parse_time(F.col(c)) for c in ("last_accessed_at", "updated_at", "ingested_at")])


def value_density(path: Column, importance: Column, seen: Column, content: Column, now: Column) -> Column:
    return importance_factor(importance) * recency_factor(path, seen, now) / F.greatest(F.length(content), F.lit(1))


def rrf(rank: Column) -> Column:
    """Of a rank from 1 on."""
    return F.lit(1.0) / (F.lit(RRF_K) + rank)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def coerced_importance(value: Column) -> Column:
    """1 to 10, or null where it isn't a number."""
    n = value.try_cast("double").try_cast("int")
    return F.when(n.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), n)))  # both skip nulls
