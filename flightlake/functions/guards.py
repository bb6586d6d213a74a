"""Arithmetic with the semantics of float arrays: NaN, clipping, floor-mod, half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(x: Column) -> Column:
    """NaN compares as larger than everything in Spark; as null it compares as unknown."""
    return F.when(F.isnan(x), None).otherwise(x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def clip(x: Column, low, high) -> Column:
    """Null and NaN stay what they are (greatest and least alone would give the bound)."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(F.lit(low).cast("double"), F.least(F.lit(high).cast("double"), x)))


def steps(seconds: float, dt: Column) -> Column:
    """Samples at spacing dt that first cover a duration: rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.bround(F.lit(seconds) / dt, 6)).cast("int"))


def saturate(x: Column, low: float, high: float) -> Column:
    """struct(value, saturated): clipped, and whether it was strictly outside."""
    return F.struct(clip(x, low, high).alias("value"), ((x < low) | (x > high)).alias("saturated"))


def scale(x: Column, mean: Column, std: Column, bound: float = 5.0) -> Column:
    """z-score, clipped."""
    return clip((x - mean) / std, -bound, bound)


def silu(x: Column) -> Column:
    return x / (F.lit(1.0) + F.exp(-x))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
