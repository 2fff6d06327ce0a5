"""The dossier of a detection: all contexts, neutral ones where nothing is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import half_up
from ..functions.text import recommendation

# What a dossier says where a context is unknown.
FALLBACK = {
    "land_cover": "unclassified_terrain", "distance_infrastructure_m": 1500.0, "distance_settlement_m": 4200.0, "is_protected": False, "slope": 10.0, "fuel_load": "moderate",
    "temperature": 24.0, "humidity": 35.0, "wind": 15.0, "gust": 25.0, "cardinal": "S", "rain": 0.0, "fwi": 40.0,
    "prior_30d": 0, "prior_90d": 0, "is_recurrent": False, "pattern": "none", "frequency": 0.0,
}
GROUPS = {"geospatial": list(FALLBACK)[:6], "weather": list(FALLBACK)[6:13], "historical": list(FALLBACK)[13:]}


def dossiers(hotspots: DataFrame, details: DataFrame) -> DataFrame:
    """Hotspots left-joined with stored details (columns of FALLBACK, some may be absent). A context that is unknown as a
    whole takes the fallback as a whole, so given and made-up values never mix in one. Of columns in both, those of the details count."""
    known = [c for c in FALLBACK if c in details.columns]
    joined = hotspots.drop(*known).join(details.select("id", *known), "id", "left")
    out = {}
    for group, columns in GROUPS.items():
        have = [c for c in columns if c in known]
        given = F.lit(False)
        for c in have:
            given = given | F.col(c).isNotNull()
        out |= {c: F.when(given, F.col(c)).otherwise(F.lit(FALLBACK[c])) if c in have else F.when(given, F.lit(None)).otherwise(F.lit(FALLBACK[c])) for c in columns}
        out[f"{group}_known"] = given
    rows = joined.withColumns(out)
    first = F.concat(F.col("acq_date"), F.lit("T"), F.substring("acq_time", 1, 2), F.lit(":"), F.substring("acq_time", 3, 2), F.lit(":00Z"))
    event = F.struct(first.alias("timestamp"), F.lit("detection").alias("type"), F.format_string("%s saw %.1f MW", "satellite", half_up(F.col("frp"), 1)).alias("summary"), F.create_map(F.lit("confidence"), F.col("confidence")).alias("details"))
    return rows.withColumns({"first_date": F.coalesce(F.col("first_date") if "first_date" in rows.columns else F.lit(None), F.col("acq_date")), "recommendation": recommendation(F.col("risk_level"), F.col("source_type")), "timeline": F.array(event)})
