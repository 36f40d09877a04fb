"""Numeric scores as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is null or empty, their lengths differ or one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(fits & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors that the mask keeps, scaled to length one; an empty one where it keeps none."""
    kept = F.filter(vectors, lambda v, i: F.element_at(mask, i + 1) != 0)
    total = lambda k: F.aggregate(F.slice(k, 2, F.greatest(F.size(k) - 1, F.lit(0))), F.element_at(k, 1), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    scaled = lambda t: let(F.sqrt(dot(t, t)), lambda n: F.when(n > 0, F.transform(t, lambda x: x / n)).otherwise(t))
    return let(kept, lambda k: F.when(F.size(k) == 0, F.array().cast("array<double>")).otherwise(let(total(k), scaled)))


def banded(x: Column, bands: Sequence[tuple[float, str]], rest: str) -> Column:
    """The label of the first band whose bound ``x`` exceeds; bounds come from high to low."""
    out = None
    for bound, label in bands:
        out = F.when(x > bound, label) if out is None else out.when(x > bound, label)
    return out.otherwise(rest)


def identity_score(name: Column, key: Column, raw: str, joined: str) -> Column:
    """50 for the exact name or id, 30 for the beginning of the name, 20 for a part of the id, else 0."""
    raw, joined = raw.lower(), joined.lower()
    name, key = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(key, F.lit("")))
    if not raw and not joined:
        return F.lit(0.0)
    asks = [q for q in (raw, joined) if q]
    any_of = lambda test: F.lit(False) if not asks else reduce(Column.__or__, map(test, asks))
    return (
        F.when(any_of(lambda q: (name == q) | (key == q)), 50.0)
        .when(any_of(lambda q: name.startswith(q)), 30.0)
        .when(any_of(lambda q: F.contains(key, F.lit(q))), 20.0)
        .otherwise(0.0)
    )


def confidence(top1: Column, top2: Column, identity: Column, stale: Column) -> Column:
    """Weighted geometric mean of gap (.35), strength (.35), identity (.15) and freshness (.15)."""
    gap = F.when(top1 > 0, clamp((top1 - F.coalesce(top2, F.lit(0.0))) / top1, 0.0, 1.0)).otherwise(0.0)
    strength = clamp(1 - F.exp(-top1 / 4), 0.0, 1.0)
    parts = ((gap, 0.35), (strength, 0.35), (F.when(identity, 1.0).otherwise(0.6), 0.15), (F.when(stale, 0.6).otherwise(1.0), 0.15))
    log = F.lit(0.0)
    for value, weight in parts:
        log = log + weight * F.log(F.greatest(value, F.lit(1e-6)))
    return F.when(top1.isNull(), None).otherwise(F.exp(log))
