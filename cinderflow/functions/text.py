"""Texts shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import half_up


def coordinates(lat: Column, lon: Column, sign: str = "") -> Column:
    """sign: what stands between a number and its direction, such as a degree sign; a dash where either is unknown."""
    known = F.format_string(f"%.4f{sign}%s, %.4f{sign}%s", F.abs(lat), F.when(lat >= 0, "N").otherwise("S"), F.abs(lon), F.when(lon >= 0, "E").otherwise("W"))
    return F.when(lat.isNull() | lon.isNull(), "\u2014").otherwise(known)


def distance(metres: Column) -> Column:
    return F.when(metres.isNull(), "N/A").when(metres < 1000, F.format_string("%d m", F.floor(metres + 0.5).cast("long"))).otherwise(F.format_string("%.1f km", half_up(metres / 1000, 1)))


def relative_time(then: Column, now: Column) -> Column:
    """just now, minutes, hours or days before `now`."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    ago = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds.isNull(), "\u2014").when(seconds < 60, "just now").when(seconds < 3600, ago(60, "m")).when(seconds < 86400, ago(3600, "h")).otherwise(ago(86400, "d"))


# Labels and descriptions of the source types in lists, labels of the alert severities.
SOURCE_LABELS = {
    "wildfire": ("Wildfire", "Rapidly spreading wildland vegetative fire"),
    "industrial": ("Industrial Facility", "Petrochemical refinery or flare stack emission"),
    "agricultural": ("Agricultural Burn", "Seasonal field clearing or stubble burning"),
    "prescribed_burn": ("Prescribed Burn", "Controlled forest management parcel treatment"),
    "urban": ("Urban / Structure", "Commercial or dense urban footprint thermal mass"),
    "volcanic": ("Volcanic Activity", "Active crater or caldera lava effusion"),
}
UNKNOWN_SOURCE = ("Unknown Source", "Unclassified thermal radiation signature")
SEVERITY_LABELS = {"critical": "CRITICAL", "warning": "WARNING"}
OTHER_SEVERITY = "ADVISORY"


def _looked_up(key: Column, table: dict[str, str], other: str) -> Column:
    """The value of a key whatever its case, `other` for one that isn't known or null."""
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(found, F.lower(key)), F.lit(other))


def level_label(level: Column) -> Column:
    return _looked_up(level, {k: k.upper() for k in ("critical", "high", "medium", "low")}, "LOW")


def source_label(source: Column) -> Column:
    return _looked_up(source, {k: label for k, (label, _) in SOURCE_LABELS.items()}, UNKNOWN_SOURCE[0])


def source_description(source: Column) -> Column:
    return _looked_up(source, {k: text for k, (_, text) in SOURCE_LABELS.items()}, UNKNOWN_SOURCE[1])


def severity_label(severity: Column) -> Column:
    return _looked_up(severity, SEVERITY_LABELS, OTHER_SEVERITY)


def megawatts(frp: Column) -> Column:
    return F.format_string("%.1f MW", half_up(F.coalesce(frp, F.lit(0.0)), 1))


def celsius(temperature: Column) -> Column:
    return F.when(temperature.isNull(), "\u2014").otherwise(F.format_string("%.1f\u00b0C", half_up(temperature, 1)))


def timestamp(at: Column) -> Column:
    """Month, day and time of day in the session's time zone; a text that is no timestamp stays as it is, null is a dash."""
    known = F.try_to_timestamp(at)
    return F.coalesce(F.date_format(known, "MMM d, HH:mm:ss"), at, F.lit("\u2014"))


def recommendation(level: Column, source: Column) -> Column:
    fire, plant = source == "wildfire", source == "industrial"
    return (
        F.when((level == "critical") & fire, "Critical: send air and ground crews now and prepare evacuation within 5 km.")
        .when((level == "critical") & plant, "Critical: call hazardous-materials response and the site's emergency manager.")
        .when(level == "critical", "Critical: send a field team to verify the source and secure the perimeter.")
        .when((level == "high") & fire, "High: inform the regional duty officer, task the next overpass, ready suppression.")
        .when((level == "high") & plant, "High: compare with the site's permits and ask the plant for its status.")
        .when(level == "high", "High: plan a surveillance flight and check local sensors.")
        .when(level == "medium", "Routine: keep tracking; look up burn permits of the district.")
        .otherwise("Log only: consistent with normal operations.")
    )
