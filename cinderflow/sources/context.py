"""Context columns under any of their known names, flat or nested, and JSON details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.common import finite

# Names under which a context value may come, the first that isn't null counts.
NAMES: dict[str, tuple[str, tuple[str, ...]]] = {
    "distance_industrial_m": ("double", ("distance_industrial_m", "distance_to_industrial_m", "distance_to_industrial_meters", "industrial_dist_m")),
    "nearby_industrial": ("long", ("nearby_industrial", "nearby_industrial_count", "industrial_count")),
    "distance_settlement_m": ("double", ("distance_settlement_m", "distance_to_settlement_m", "distance_to_settlement_meters", "settlement_dist_m")),
    "distance_infrastructure_m": ("double", ("distance_infrastructure_m", "distance_to_infrastructure_m", "distance_to_infrastructure_meters", "distance_to_infra_m", "infra_dist_m")),
    "is_protected": ("boolean", ("is_protected", "is_protected_area")),
    "slope": ("double", ("slope_degrees", "slope_deg", "slope")),
    "land_cover": ("string", ("land_cover", "landcover")),
    "temperature": ("double", ("temperature_celsius", "temperature_c", "temp_c", "temp", "temperature")),
    "humidity": ("double", ("relative_humidity_percent", "relative_humidity_pct", "rh", "humidity")),
    "wind": ("double", ("wind_speed_kmh", "wind_speed", "wind")),
    "gust": ("double", ("wind_gust_kmh", "wind_gust", "gust")),
    "rain": ("double", ("precipitation_mm", "precipitation", "rain")),
    "fwi": ("double", ("fire_weather_index", "fwi")),
    "prior_30d": ("long", ("prior_detections_30d", "historical_recurrence", "historical_detections_30d", "prior_detections", "prior_30d")),
    "prior_90d": ("long", ("prior_detections_90d", "prior_90d")),
    "is_recurrent": ("boolean", ("is_recurrent_site", "is_recurrent")),
    "persistence": ("double", ("persistence_score", "detection_frequency_score", "persistence")),
}
GROUPS = ("geospatial", "weather", "historical")
DETAIL = {
    "geospatial": "land_cover string, distance_to_settlement_meters double, distance_to_infrastructure_meters double, is_protected_area boolean, slope_degrees double",
    "weather": "temperature_celsius double, relative_humidity_percent double, wind_speed_kmh double, wind_gust_kmh double, precipitation_mm double, fire_weather_index double",
    "historical": "prior_detections_30d int, prior_detections_90d int, is_recurrent_site boolean, detection_frequency_score double",
}


def _typed(x: Column, kind: str) -> Column:
    """Casts that give null, never an error; whole numbers drop their fraction; true, 1, yes and t are true."""
    text = F.trim(x.cast("string"))
    if kind == "double":
        return finite(text.try_cast("double"))
    if kind == "long":
        return F.floor(finite(text.try_cast("double"))).cast("long")
    if kind == "boolean":
        return F.when(F.nullif(text, F.lit("")).isNotNull(), F.lower(text).isin("true", "1", "yes", "t"))
    return F.nullif(text, F.lit(""))


def resolved(rows: DataFrame) -> DataFrame:
    """The rows with every context column under its own name, from the first name that has a value: for each name the top
    level, then the nested groups."""
    nested = {g: rows.schema[g].dataType.names for g in GROUPS if g in rows.columns and isinstance(rows.schema[g].dataType, StructType)}
    out = {}
    for name, (kind, aliases) in NAMES.items():
        found = []
        for alias in aliases:
            found += [F.col(f"`{alias}`")] if alias in rows.columns else []
            found += [F.col(f"{g}.{alias}") for g, fields in nested.items() if alias in fields]
        out[name] = F.coalesce(*(_typed(x, kind) for x in found)) if found else F.lit(None).cast(kind)
    return rows.withColumns(out)


def decoded(details: DataFrame) -> DataFrame:
    """(id, geospatial, weather, historical) from JSON text columns of those names; broken JSON is null."""
    return details.select("id", *(F.from_json(g, DETAIL[g], {"mode": "PERMISSIVE"}).alias(g) for g in GROUPS))


def encoded(rows: DataFrame) -> DataFrame:
    """The three groups as JSON text."""
    return rows.select("id", *(F.to_json(g).alias(g) for g in GROUPS))
