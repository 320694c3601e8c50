"""Rounding and ratio helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up(c: Column) -> Column:
    """Round to a whole number, .5 always upwards (also for negative values)."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def pct(part: Column, base: Column) -> Column:
    """Whole percent, 0 for an empty base."""
    return F.when(base > 0, half_up(part.cast("double") / base.cast("double") * 100)).otherwise(F.lit(0).cast("bigint"))


def ratio(part: Column, base: Column) -> Column:
    """part / base as double, NULL for an empty base."""
    return part.cast("double") / F.nullif(base.cast("double"), F.lit(0.0))


def unit_scale(c: Column, full: float) -> Column:
    """Linear 0..1 scale, clipped: `full` or more gives 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double") / F.lit(float(full))))
