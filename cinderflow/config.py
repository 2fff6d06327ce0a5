"""Thresholds of the analytics. They define the results."""

from __future__ import annotations

from dataclasses import dataclass

# Satellite codes and their names.
SATELLITES = {
    "N": "Suomi-NPP", "SNPP": "Suomi-NPP", "SUOMI-NPP": "Suomi-NPP",
    "1": "NOAA-20", "NOAA20": "NOAA-20", "NOAA-20": "NOAA-20", "JPSS-1": "NOAA-20",
    "2": "NOAA-21", "NOAA21": "NOAA-21", "NOAA-21": "NOAA-21", "JPSS-2": "NOAA-21",
    "T": "Terra", "TERRA": "Terra",
    "A": "Aqua", "AQUA": "Aqua",
}
# Labels and drivers of the source types.
SOURCES = {
    "wildfire": ("Wildfire / Forest Fire", "Vegetative dry fuel & wind propagation"),
    "industrial": ("Industrial Facility / Flare Stack", "Petrochemical, refining, & gas processing"),
    "agricultural": ("Agricultural Residue Burn", "Seasonal crop clearing & stubble combustion"),
    "prescribed_burn": ("Controlled / Prescribed Burn", "Managed land conservation fuel reduction"),
    "urban": ("Urban Structural / Heat Anomaly", "High thermal mass, roofing, or localized structural fire"),
    "volcanic": ("Volcanic / Geothermal Activity", "Magmatic effusion & geothermal vents"),
    "unknown": ("Unclassified Thermal Signature", "Undergoing multi-spectral model verification"),
}
# Substrings of a land cover that make it one of four kinds.
COVER_WORDS = {
    "vegetation": ("forest", "woodland", "trees", "chaparral", "shrub", "bush", "grass", "grassland", "jungle", "taiga", "savanna", "scrub"),
    "industrial": ("industrial", "refinery", "factory", "plant", "manufacturing", "chemical", "smelter", "foundry", "stack", "quarry", "mine", "power_plant"),
    "agricultural": ("agri", "crop", "cropland", "farmland", "field", "stubble", "paddy", "pasture"),
    "urban": ("urban", "residential", "commercial", "city", "town", "building"),
}
LEVELS = ("low", "medium", "high", "critical")
# Compass points from north, clockwise.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
# Source pairs that don't join one incident beyond 300 m.
INCOMPATIBLE = (("volcanic", "agricultural"), ("volcanic", "urban"), ("industrial", "wildfire"))
EARTH_RADIUS_M = 6_371_000.0


# All figures of the dataclasses below.
@dataclass(frozen=True)
class Recurrence:
    radius_m: float = 1000.0
    short_days: int = 30
    long_days: int = 90


@dataclass(frozen=True)
class Anomaly:
    mean_frp: float = 25.0
    std_frp: float = 20.0
    sigma: float = 2.0
    suppress_sigma: float = 3.0
    suppress_passes: int = 15
    least_score: float = 0.65
    trees: int = 50
    contamination: float = 0.10
    sample: int = 256
    seed: int = 42


@dataclass(frozen=True)
class Risk:
    frp: float = 0.35
    weather: float = 0.25
    proximity: float = 0.20
    history: float = 0.10
    anomaly: float = 0.10


@dataclass(frozen=True)
class Incidents:
    distance_km: float = 1.5
    window_hours: float = 24.0
    envelope_km: float = 5.0
    incompatible_km: float = 0.3


@dataclass(frozen=True)
class Alerts:
    critical: float = 75.0
    warning: float = 50.0
    info: float = 25.0
    include_medium: bool = False
