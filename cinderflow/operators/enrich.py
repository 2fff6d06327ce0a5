"""Geospatial, weather and historical context of each hotspot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Recurrence
from ..functions.common import half_up
from ..functions.geo import compass, haversine_m
from ..functions.scores import fire_weather_index, forecast
from ..plans.lineage import shuffled
from ..sources.ingest import numbered
from .history import recurrence
from .spatial import PLACE, as_right, coded, named, placed, within

SEARCH_M = 10_000.0


def geo_context(points: DataFrame, features: DataFrame, search_m: float = SEARCH_M, key: str = "id") -> DataFrame:
    """Nearest features and counts by category, protection and land cover, from one candidate join of places and one aggregate of longs."""
    known = numbered(placed(features.select("id", "name", "category", *PLACE), "name"), ["id"])
    pairs = within(points.select(*PLACE).distinct(), as_right(known, "sequence", "category", "n"), max(search_m, 10_000.0))
    kind = F.when(F.col("r_category").isin("protected_area", "natural"), "protected").otherwise(F.col("r_category"))
    pairs = pairs.withColumns({"kind": kind, "code": coded(F.col("distance_m"), F.col("r_sequence"))})
    reach = {"industrial": search_m, "infrastructure": search_m, "settlement": search_m, "protected": 3000.0}
    best = [F.min(F.when((F.col("kind") == k) & (F.col("distance_m") <= most), F.col("code"))).alias(f"c_{k}") for k, most in reach.items()]
    counts = [F.sum(F.when((F.col("kind") == k) & (F.col("distance_m") <= r), F.col("r_n"))).alias(f"nearby_{k}") for k, r in (("industrial", 5000.0), ("infrastructure", 5000.0), ("settlement", 10_000.0))]
    found = pairs.groupBy(*PLACE).agg(*best, *counts)
    for k in reach:
        found = named(found, known, f"c_{k}", "id", "name", *PLACE)
        metres = haversine_m(F.col("latitude"), F.col("longitude"), F.col(f"c_{k}_latitude"), F.col(f"c_{k}_longitude"))
        found = found.withColumn(k, F.when(F.col(f"c_{k}").isNotNull(), F.struct(F.col(f"c_{k}_id").alias("f"), F.col(f"c_{k}_name").alias("name"), metres.alias("m"))))
    found = points.select(key, *PLACE).join(shuffled(found.select(*PLACE, *reach, *(f"nearby_{k}" for k in ("industrial", "infrastructure", "settlement")))), PLACE, "left")
    best = reach
    ind, prot, town = F.col("industrial.m") <= 400, F.col("protected.m") <= 1000, F.col("settlement.m") <= 1000
    return found.select(
        key,
        *(F.col(f"{k}.f").alias(f"nearest_{k}") for k in best),
        *(F.col(f"{k}.name").alias(f"nearest_{k}_name") for k in best),
        *(half_up(F.col(f"{k}.m"), 1).alias(f"distance_{k}_m") for k in best),
        *(F.coalesce(f"nearby_{k}", F.lit(0).cast("long")).alias(f"nearby_{k}") for k in ("industrial", "infrastructure", "settlement")),
        F.coalesce(F.col("protected.m") <= 1500, F.lit(False)).alias("is_protected"),
        F.when(ind, "industrial_site").when(prot, "dense_coniferous_forest").when(town, "urban_wildland_interface").otherwise("chaparral_scrubland").alias("land_cover"),
        F.when(ind, "non_vegetated").when(prot, "extreme_dry_chaparral").when(town, "moderate_mixed").otherwise("moderate").alias("fuel_load"),
    )


def weather_context(points: DataFrame, weather: DataFrame, key: str = "id", first_by: str | None = None) -> DataFrame:
    """Weather of the point's grid cell (two decimals), with index, compass point and summary; nulls where there is none. Of several
    rows of a cell one whole row counts: the first in the order of column `first_by`, or, without it, the greatest in the order of temperature,
    humidity and so on."""
    values = F.struct("temperature", "humidity", "wind", "gust", "direction", "rain")
    one = F.min_by(values, F.struct(first_by, values)) if first_by else F.max(values)
    grid = weather.groupBy("glat", "glon").agg(one.alias("w")).select("glat", "glon", "w.*")
    cleaned = grid.select(
        "glat", "glon", "temperature",
        F.least(F.greatest("humidity", F.lit(0.0)), F.lit(100.0)).alias("humidity"),
        F.greatest("wind", F.lit(0.0)).alias("wind"),
        "gust",
        F.pmod("direction", F.lit(360.0)).alias("direction"),
        F.greatest("rain", F.lit(0.0)).alias("rain"),
    )
    cell = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
    joined = points.select(key, cell("latitude").alias("glat"), cell("longitude").alias("glon")).join(cleaned, ["glat", "glon"], "left")
    fwi = fire_weather_index(F.col("temperature"), F.col("humidity"), F.col("wind"), F.col("gust"), F.col("rain"))
    known = F.col("temperature").isNotNull()
    cardinal = compass(F.col("direction"))
    return joined.select(
        key, "temperature", "humidity", "wind", "gust", "rain",
        F.when(known, cardinal).alias("cardinal"),
        F.when(known, fwi).alias("fwi"),
        F.when(known, "available").otherwise("unavailable").alias("weather_status"),
        F.when(known, forecast(fwi, F.col("temperature"), F.col("humidity"), F.col("wind"), cardinal)).alias("forecast"),
    )


def presented(weather: DataFrame) -> DataFrame:
    """As shown to people: zeros where weather is unavailable. Scores use the nulls instead, for zero humidity would read as extreme drought."""
    return weather.na.fill(0.0, ["temperature", "humidity", "wind", "gust", "rain", "fwi"]).na.fill("N/A", ["cardinal"])


def status(parts: list[Column]) -> Column:
    """complete, partial or unavailable, by how many of the boolean parts hold."""
    have = sum((F.coalesce(p, F.lit(False)).cast("int") for p in parts[1:]), F.coalesce(parts[0], F.lit(False)).cast("int"))
    return F.when(have == len(parts), "complete").when(have == 0, "unavailable").otherwise("partial")


def enriched(hotspots: DataFrame, features: DataFrame, weather: DataFrame, config: Recurrence = Recurrence()) -> DataFrame:
    """Hotspots with all three contexts. Each context is joined on id, which all three are already grouped by."""
    geo = geo_context(hotspots, features)
    wx = weather_context(hotspots, weather)
    past = recurrence(hotspots, config)
    out = hotspots.join(shuffled(geo), "id", "left").join(shuffled(wx), "id", "left").join(shuffled(past), "id", "left")
    return out.withColumn("enrichment", status([F.col("land_cover").isNotNull(), F.col("weather_status") == "available", F.col("prior_30d").isNotNull()]))
