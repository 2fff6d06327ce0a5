"""Map features from OpenStreetMap elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import valid_point


def categorized(tags: Column) -> tuple[Column, Column, Column]:
    """(category, feature_type, name) by the first rule that fits. The rules, their types and names are fixed values."""
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    has = lambda k: F.map_contains_key(tags, F.lit(k))
    given = F.coalesce(F.nullif(tag("name"), F.lit("")), F.nullif(tag("description"), F.lit("")))
    named = lambda *parts: F.coalesce(given, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))
    works = F.coalesce(F.nullif(tag("industrial"), F.lit("")), F.lit("industrial_complex"))
    fuel = F.coalesce(F.nullif(tag("generator:source"), F.lit("")), F.nullif(tag("plant:source"), F.lit("")), F.lit("energy"))
    ref = F.nullif(tag("ref"), F.lit(""))
    road = F.when(ref.isNotNull() & given.isNotNull(), F.concat(ref, F.lit(" ("), given, F.lit(")"))).otherwise(F.coalesce(given, ref, F.concat(F.lit("Highway ("), tag("highway"), F.lit(")"))))
    rules = [
        (tag("landuse") == "industrial", "industrial", works, named("Industrial Facility (", works, ")")),
        (tag("man_made").isin("works", "refinery", "gasometer"), "industrial", tag("man_made"), named("Industrial Works")),
        (has("industrial"), "industrial", tag("industrial"), named("Industrial (", tag("industrial"), ")")),
        (tag("power").isin("plant", "generator"), "industrial", F.concat(F.lit("power_"), fuel), named("Power Generation Plant (", fuel, ")")),
        (tag("power").isin("substation", "line", "minor_line", "switch"), "infrastructure", F.concat(F.lit("power_"), tag("power")), named("Power ", F.initcap(tag("power")))),
        (has("highway"), "infrastructure", F.concat(F.lit("highway_"), tag("highway")), road),
        (has("pipeline"), "infrastructure", F.lit("pipeline"), named("Pipeline (", F.coalesce(tag("substance"), F.lit("pipeline")), ")")),
        (has("place"), "settlement", tag("place"), named("Settlement (", tag("place"), ")")),
        (tag("boundary").isin("national_park", "protected_area"), "protected_area", F.lit("protected_area"), named("Protected Conservation Area")),
        (tag("leisure") == "nature_reserve", "protected_area", F.lit("nature_reserve"), named("Nature Reserve")),
        ((tag("landuse") == "forest") | (tag("natural") == "wood"), "natural", F.lit("forest"), named("Forest / Woodland Parcel")),
    ]
    out = []
    for k, other in ((1, F.lit("other")), (2, F.lit("unknown")), (3, named("Geographic Feature"))):
        chain = F
        for rule in rules:
            value = rule[k] if isinstance(rule[k], Column) else F.lit(rule[k])
            chain = chain.when(F.coalesce(rule[0], F.lit(False)), value)
        out.append(chain.otherwise(other))
    return out[0], out[1], out[2]


def features(elements: DataFrame, column: str = "elements") -> DataFrame:
    """One row for each element with valid coordinates: nodes by their own, others by their centre or the middle of their bounds."""
    e = elements.select(F.explode(column).alias("e"))
    lat = F.when(F.col("e.type") == "node", F.col("e.lat")).otherwise(F.coalesce("e.center.lat", (F.col("e.bounds.minlat") + F.col("e.bounds.maxlat")) / 2))
    lon = F.when(F.col("e.type") == "node", F.col("e.lon")).otherwise(F.coalesce("e.center.lon", (F.col("e.bounds.minlon") + F.col("e.bounds.maxlon")) / 2))
    tags = F.coalesce(F.col("e.tags"), F.create_map().cast("map<string,string>"))
    category, kind, name = categorized(tags)
    found = e.select(F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("id"), name.alias("name"), category.alias("category"), kind.alias("feature_type"), lat.alias("latitude"), lon.alias("longitude"), tags.alias("tags"))
    return found.where(valid_point(F.col("latitude"), F.col("longitude")))
