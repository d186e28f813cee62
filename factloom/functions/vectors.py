"""Probabilities and vectors as Column expressions over arrays (X-24, X-25, V-05)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """X-24: probabilities at a temperature; shifted by the maximum, so large logits don't overflow."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / total(e))


def argmax(a: Column) -> Column:
    """X-24: first position of the maximum, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """X-25: unit length; the zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def masked_mean(vectors: Column, mask: Column) -> Column:
    """X-25: mean of the vectors whose mask is 1; no such vector: null."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["v"])
    first = F.get(kept, F.lit(0))
    return F.transform(first, lambda _, i: F.aggregate(kept, F.lit(0.0), lambda s, v: s + F.get(v, i)) / F.size(kept))
