"""Distances, boxes, compass points, grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COMPASS, EARTH_RADIUS_M
from .common import finite


def valid_point(lat: Column, lon: Column) -> Column:
    return F.coalesce(finite(lat).between(-90, 90) & finite(lon).between(-180, 180), F.lit(False))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; equal points are exactly 0 apart."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (F.sin(dlon) * F.sin(dlon))
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    return F.when((lat1 == lat2) & (lon1 == lon2), 0.0).otherwise(2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


def compass(degrees: Column) -> Column:
    sector = (F.floor((F.pmod(degrees, F.lit(360.0)) + 11.25) / 22.5) % 16).cast("int")
    return F.when(finite(degrees).isNull(), "N/A").otherwise(F.element_at(F.array(*map(F.lit, COMPASS)), sector + 1))


def lat_cell(lat: Column, radius_m: float) -> Column:
    """Bands of latitude at least `radius_m` high."""
    return F.floor(lat / degrees_of(radius_m)).cast("long")


def degrees_of(radius_m: float) -> float:
    """Degrees of latitude that `radius_m` spans, with a little to spare."""
    return radius_m / (EARTH_RADIUS_M * math.pi / 180) * 1.001


def lat_bands_around(lat: Column, radius_m: float, cell_m: float | None = None) -> Column:
    """All bands (`cell_m` high, or `radius_m`) that hold points within `radius_m` of a latitude."""
    cell_m = cell_m or radius_m
    return F.sequence(lat_cell(lat - degrees_of(radius_m), cell_m), lat_cell(lat + degrees_of(radius_m), cell_m))


def lon_width(band: Column, radius_m: float) -> Column:
    """Degrees of longitude of a band's cells: at least `radius_m` at the edge of the band, or of a neighbour, that is nearest to a pole."""
    edge = F.least((F.greatest(F.abs(band - 1), F.abs(band + 2)) * degrees_of(radius_m)), F.lit(89.9))
    return F.least(degrees_of(radius_m) / F.cos(F.radians(edge)), F.lit(360.0))


def lon_cell(band: Column, lon: Column, radius_m: float) -> Column:
    """Cells of a band. The last one before the date line may be narrower; what lies beyond 180 has cells of its own, further on."""
    return _cell(lon + 180, lon_width(band, radius_m))


def _cell(east: Column, width: Column) -> Column:
    return F.floor(east / width).cast("long") + (east > 360).cast("long")


def lon_cells_around(band: Column, lat: Column, lon: Column, radius_m: float, cell_m: float | None = None) -> Column:
    """All cells of a band (`cell_m` wide, or `radius_m`) that hold points within `radius_m` of a point, across the date line too. No point of the circle is further
    off in longitude than `reach`; a circle that holds a pole, or nearly, has all longitudes. A longitude that isn't from -180 to 180 is taken as it stands and looks
    over no date line. Cells are counted from the point's own, so there are as few of them at any longitude."""
    width = lon_width(band, cell_m or radius_m)
    far = F.sin(F.radians(F.lit(degrees_of(radius_m)))) / F.cos(F.radians(F.least(F.abs(lat), F.lit(89.9))))
    reach = F.when(F.abs(lat) + degrees_of(radius_m) >= 89.9, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(far, F.lit(1.0)))) * 1.001)
    low, high = lon + 180 - reach, lon + 180 + reach
    cells = lambda a, b: F.sequence(_cell(a, width), _cell(b, width))
    none, inside = F.array().cast("array<long>"), lon.between(-180, 180)
    west = F.when(inside & (low < 0), cells(low + 360, F.lit(360.0))).otherwise(none)
    east = F.when(inside & (high > 360), cells(F.lit(0.0), high - 360)).otherwise(none)
    return F.array_distinct(F.concat(cells(low, high), west, east))
