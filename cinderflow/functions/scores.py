"""Scores of single rows: intensity, proximity, weather, baseline risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COVER_WORDS
from .common import clamp, half_up


def level_of(score: Column) -> Column:
    return F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "medium").otherwise("low")


def level_rank(level: Column) -> Column:
    return F.when(level == "critical", 3).when(level == "high", 2).when(level == "medium", 1).otherwise(0)


def tier(level: Column, score: Column) -> Column:
    """The worse of a given level and the score's own."""
    rank = F.greatest(level_rank(F.coalesce(level, F.lit("low"))), level_rank(level_of(F.coalesce(score, F.lit(0.0)))))
    return F.when(rank == 3, "critical").when(rank == 2, "high").when(rank == 1, "medium").otherwise("low")


def baseline_risk(frp: Column, brightness: Column) -> tuple[Column, Column, Column]:
    """(score, level, anomaly) from radiance alone. Brightness can lift the level while a low frp keeps the score low."""
    top, high, middle = (frp >= 100) | (brightness >= 355), (frp >= 50) | (brightness >= 340), (frp >= 20) | (brightness >= 325)
    score = F.when(top, F.least(F.lit(99.0), 75 + (frp - 100) * 0.15)).when(high, 60 + (frp - 50) * 0.3).when(middle, 35 + (frp - 20) * 0.8).otherwise(F.greatest(F.lit(5.0), frp * 1.5))
    level = F.when(top, "critical").when(high, "high").when(middle, "medium").otherwise("low")
    return half_up(score, 1), level, F.when(top, True).when(high, frp >= 80).otherwise(False)


def frp_norm(frp: Column) -> Column:
    return clamp(F.log1p(F.greatest(frp, F.lit(0.0))) / F.log1p(F.lit(250.0)), 0, 1)


def brightness_norm(brightness: Column) -> Column:
    return clamp((brightness - 290) / 140, 0, 1)


def proximity(distance: Column, most: float, near: float) -> Column:
    """1 up to `near`, 0 from `most` or where unknown, linear between."""
    return F.when(distance.isNull() | (distance < 0) | F.isnan(distance), 0.0).when(distance <= near, 1.0).when(distance >= most, 0.0).otherwise((most - distance) / (most - near))


def cover_flag(land_cover: Column, kind: str) -> Column:
    return F.coalesce(F.lower(F.trim(land_cover)).rlike("|".join(COVER_WORDS[kind])), F.lit(False))


def weather_score(temp: Column, humidity: Column, wind: Column, rain: Column, fwi: Column) -> Column:
    """0..1; null if nothing about the weather is known. Missing parts take middling values."""
    windy = F.coalesce(clamp(wind / 55, 0, 1), F.lit(0.2))
    dry = F.coalesce(clamp((100 - humidity) / 85, 0, 1), F.lit(0.5))
    warm = F.coalesce(clamp((temp - 12) / 28, 0, 1), F.lit(0.3))
    windy = F.when(wind.isNull(), 0.2).otherwise(windy)
    dry = F.when(humidity.isNull(), 0.5).otherwise(dry)
    warm = F.when(temp.isNull(), 0.3).otherwise(warm)
    score = 0.45 * windy + 0.40 * dry + 0.15 * warm
    wet = F.when(rain > 0, F.greatest(F.lit(0.1), 1 - rain / 10)).otherwise(1.0)
    return F.when(fwi.isNotNull(), clamp(fwi / 100, 0, 1)).when(temp.isNull() & humidity.isNull() & wind.isNull(), None).otherwise(clamp(score * wet, 0, 1))


def fire_weather_index(temp: Column, humidity: Column, wind: Column, gust: Column, rain: Column) -> Column:
    blow = F.when(gust > wind, 0.7 * wind + 0.3 * gust).otherwise(wind)
    dry = clamp((temp - 5) * 0.875, 0, 35) + clamp((100 - humidity) * 0.388, 0, 35) + clamp(blow / 50 * 30, 0, 30)
    wet = F.when(rain > 0, 1 - F.least(F.lit(0.8), rain * 0.15)).otherwise(1.0)
    return half_up(clamp(dry * wet, 0, 100), 1)


def forecast(fwi: Column, temp: Column, humidity: Column, wind: Column, cardinal: Column) -> Column:
    band = F.when(fwi >= 80, "Critical fire weather").when(fwi >= 60, "Elevated fire danger").when(fwi >= 35, "Moderate conditions").otherwise("Low hazard")
    return F.concat(band, F.format_string(": %.1f C, humidity %.0f %%, wind %.1f km/h %s", half_up(temp, 1), half_up(humidity, 0), half_up(wind, 1), cardinal))
