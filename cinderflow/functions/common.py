"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int) -> Column:
    """x rounded half up by floor arithmetic, the same on every engine."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; NaN counts as low."""
    return F.least(F.greatest(F.nanvl(x, F.lit(float(low))), F.lit(float(low))), F.lit(float(high)))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def number(x: Column) -> Column:
    """Text as a finite double, else null."""
    return finite(x.try_cast("double"))


def cents_mean(x: Column, places: int) -> Column:
    """Mean of a two-decimal column from an exact sum of hundredths, rounded half up; 0 over no rows."""
    total = F.sum(F.floor(x * 100 + 0.5).cast("long"))
    return F.coalesce(half_up(total / F.count(x) / 100.0, places), F.lit(0.0))


def title_case(x: Column) -> Column:
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))
