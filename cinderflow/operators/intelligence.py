"""Features, source classes, anomaly, risk and explanations as columns over a hotspot and its context.

Input columns (all but id, frp, brightness and confidence may be null): land_cover, distance_industrial_m,
nearby_industrial, distance_settlement_m, distance_infrastructure_m, is_protected, slope, temperature, humidity, wind, rain,
fwi, prior_30d, prior_90d, is_recurrent, persistence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Anomaly, Risk
from ..functions.common import clamp, half_up, number
from ..functions.scores import brightness_norm, cover_flag, frp_norm, level_of, proximity, weather_score
from ..functions.text import recommendation

CONTEXT = {
    "land_cover": "string", "distance_industrial_m": "double", "nearby_industrial": "long", "distance_settlement_m": "double",
    "distance_infrastructure_m": "double", "is_protected": "boolean", "slope": "double", "temperature": "double", "humidity": "double",
    "wind": "double", "rain": "double", "fwi": "double", "prior_30d": "long", "prior_90d": "long", "is_recurrent": "boolean", "persistence": "double",
}
CLASSES = ("vegetation_fire", "potential_industrial_fire", "controlled_heat_source", "persistent_thermal_source", "unknown")


def with_context(rows: DataFrame) -> DataFrame:
    """Adds the context columns that are missing, as nulls."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in CONTEXT.items() if c not in rows.columns}) if set(CONTEXT) - set(rows.columns) else rows


def confidence_score(raw: Column) -> Column:
    """0..1 from a label or a number (over 1: per cent)."""
    text, value = F.lower(F.trim(raw)), number(F.trim(raw))
    return F.when(text.isin("high", "h"), 0.95).when(text.isin("low", "l"), 0.35).when(value > 1, clamp(value / 100, 0, 1)).when(value.isNotNull(), clamp(value, 0, 1)).otherwise(0.65)


def confidence_label(raw: Column) -> Column:
    """low, nominal or high: a label or its first letter, else by the score of a number (high from 0.8, low below 0.4)."""
    text, score = F.lower(F.trim(raw)), confidence_score(raw)
    return F.when(text.isin("high", "h") | (score >= 0.8), "high").when(text.isin("low", "l") | (score < 0.4), "low").otherwise("nominal")


def input_normalized(rows: DataFrame) -> DataFrame:
    """What the engine reads of a detection that comes in any shape, text or numbers: id (id, hotspot_id, else UNKNOWN-HOTSPOT), frp (0 if
    unknown or below), brightness (that, else bright_ti4; unknown or zero is 310), confidence as label and score, satellite and
    instrument (VIIRS if unknown), position, daynight in capitals. Columns may be missing; blank texts are unknown."""
    text = lambda name: F.nullif(F.trim(F.col(name).cast("string")), F.lit("")) if name in rows.columns else F.lit(None).cast("string")
    value = lambda name: number(text(name))
    bright = F.coalesce(F.nullif(value("brightness"), F.lit(0.0)), F.nullif(value("bright_ti4"), F.lit(0.0)), F.lit(310.0))
    raw = F.coalesce(text("confidence"), F.lit("nominal"))
    return rows.select(
        F.coalesce(text("id"), text("hotspot_id"), F.lit("UNKNOWN-HOTSPOT")).alias("id"),
        F.greatest(F.coalesce(value("frp"), F.lit(0.0)), F.lit(0.0)).alias("frp"),
        F.greatest(bright, F.lit(0.0)).alias("brightness"),
        confidence_label(raw).alias("confidence"),
        confidence_score(raw).alias("confidence_score"),
        F.coalesce(text("satellite"), F.lit("VIIRS")).alias("satellite"),
        F.coalesce(text("instrument"), F.lit("VIIRS")).alias("instrument"),
        value("latitude").alias("latitude"),
        value("longitude").alias("longitude"),
        F.upper(text("daynight")).alias("daynight"),
    )


def any_known(*columns: str) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in columns))


def features(rows: DataFrame) -> DataFrame:
    """The rows with all feature columns."""
    rows = with_context(rows)
    c = F.col
    frp = F.greatest(F.nanvl(F.coalesce(c("frp"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    bright = F.when(F.coalesce(c("brightness"), F.lit(0.0)) == 0, 310.0).otherwise(c("brightness"))
    base = rows.withColumns({
        "f_frp": frp,
        "f_brightness": bright,
        "f_confidence": confidence_score(c("confidence")),
        **{f"is_{k}": cover_flag(c("land_cover"), k) for k in ("vegetation", "industrial", "agricultural", "urban")},
        "has_geo": any_known("distance_industrial_m", "nearby_industrial", "distance_settlement_m", "distance_infrastructure_m", "is_protected", "land_cover"),
        "has_weather": any_known("temperature", "humidity", "wind", "rain", "fwi"),
        "has_history": any_known("prior_30d", "prior_90d", "is_recurrent", "persistence"),
        "protected": F.coalesce(c("is_protected"), F.lit(False)),
        "recurrent": F.coalesce(c("is_recurrent"), F.lit(False)) | F.coalesce(c("prior_30d") >= 10, F.lit(False)),
    })
    near = proximity(c("distance_industrial_m"), 3000, 800)
    near = F.least(F.lit(1.0), near + F.when(c("nearby_industrial") > 0, F.least(F.lit(0.3), c("nearby_industrial") * 0.1)).otherwise(0.0))
    return base.withColumns({
        "frp_norm": half_up(frp_norm(c("f_frp")), 4),
        "brightness_norm": half_up(brightness_norm(c("f_brightness")), 4),
        "industrial_proximity": half_up(F.when(c("is_industrial"), F.greatest(near, F.lit(0.85))).otherwise(near), 4),
        "settlement_proximity": half_up(proximity(c("distance_settlement_m"), 7500, 1500), 4),
        "infrastructure_proximity": half_up(proximity(c("distance_infrastructure_m"), 5000, 500), 4),
        "slope_factor": half_up(F.coalesce(clamp(F.coalesce(c("slope"), F.lit(0.0)) / 45, 0, 1), F.lit(0.0)), 4),
        "persistence_score": half_up(F.when(c("persistence").isNotNull(), clamp(c("persistence"), 0, 1)).when(c("prior_30d").isNotNull(), clamp(c("prior_30d") / 20.0, 0, 1)).when(c("prior_90d").isNotNull(), clamp(c("prior_90d") / 45.0, 0, 1)).otherwise(0.0), 4),
        "weather_score": half_up(weather_score(c("temperature"), c("humidity"), c("wind"), c("rain"), c("fwi")), 4),
    })


def ml_vector() -> Column:
    return F.array("frp_norm", "brightness_norm", "f_confidence", "industrial_proximity", "settlement_proximity", F.coalesce("weather_score", F.lit(0.35)), "persistence_score", "slope_factor")


def evidence() -> dict[str, Column]:
    """Evidence for each class; sums of rules."""
    c = F.col
    p, s, frp, conf, w = c("industrial_proximity"), c("persistence_score"), c("f_frp"), c("f_confidence"), c("weather_score")
    pts = lambda test, value: F.when(F.coalesce(test, F.lit(False)), value).otherwise(0.0)
    n30 = F.coalesce("prior_30d", F.lit(0))
    stays = (s >= 0.5) | (n30 >= 10)
    persistent = 0.10 + pts(stays, 1 + F.least(F.lit(1.2), 1.5 * s) + pts(p >= 0.5, 0.8))
    at_plant = (p >= 0.4) | c("is_industrial")
    hot, warm = (frp >= 40) & (conf >= 0.7), frp >= 20
    industrial = 0.10 + pts(at_plant & hot, 1.2 * p + 1.2 + pts(s < 0.3, 0.6)) + pts(at_plant & ~hot & warm, 1.2 * p + 0.4)
    managed = c("protected") & (frp >= 3) & (frp < 55)
    controlled = 0.10 + F.when(managed, 1.8).when(c("is_agricultural"), 1.2).when((p >= 0.7) & (frp < 30) & (s >= 0.3), 0.7).otherwise(0.0)
    wild = 1.0 + pts(frp >= 35, 0.6) + pts(w >= 0.5, 0.8 * w) + pts(c("slope_factor") > 0.3, 0.4 * c("slope_factor")) + pts(p < 0.2, 0.5)
    no_plant = ~(c("is_industrial") | (p >= 0.4))
    vegetation = 0.10 + F.when(c("is_vegetation"), F.when(c("protected") & (frp < 55), 0.35).otherwise(wild)).when(no_plant & (frp >= 60), 0.9).otherwise(0.0)
    unknown = 0.15 + pts(conf < 0.45, 0.8) + pts(~c("has_geo") & ~c("has_history") & ~c("has_weather"), 0.9) + pts((frp < 8) & ~c("recurrent") & ~c("protected"), 0.4)
    return dict(zip(CLASSES, (vegetation, industrial, controlled, persistent, unknown), strict=True))


def classified(rows: DataFrame) -> DataFrame:
    """Adds p_<class>, class (the first of the most probable), margin, source and class_confidence to `features` rows."""
    rows = rows.withColumns({f"__e_{k}": F.greatest(F.lit(0.01), v) for k, v in evidence().items()})
    total = reduce(lambda a, b: a + b, (F.col(f"__e_{k}") for k in CLASSES))
    rows = rows.withColumns({f"p_{k}": half_up(F.col(f"__e_{k}") / total, 4) for k in CLASSES}).drop(*(f"__e_{k}" for k in CLASSES))
    p = [F.col(f"p_{k}") for k in CLASSES]
    ordered = F.sort_array(F.array(*p), asc=False)
    top = F.greatest(*p)
    best = reduce(lambda chain, k: chain.when(F.col(f"p_{k}") == top, k), CLASSES[:-1], F).otherwise(CLASSES[-1])
    rows = rows.withColumns({"class": best, "top": top, "margin": ordered[0] - ordered[1]})
    kind = F.col("class")
    source = F.when(kind == CLASSES[0], "wildfire").when(kind.isin(CLASSES[1], CLASSES[3]), "industrial").when((kind == CLASSES[2]) & F.col("is_agricultural"), "agricultural").when(kind == CLASSES[2], "prescribed_burn").otherwise("unknown")
    yes = lambda c: F.col(c).cast("double")
    complete = 0.35 + 0.25 * yes("has_geo") + 0.20 * yes("has_weather") + 0.20 * yes("has_history")
    strength = 0.5 * F.col("f_confidence") + 0.5 * F.col("frp_norm")
    factor = 0.5 + F.least(F.lit(0.5), 1.5 * F.col("margin"))
    sure = (0.45 * top + 0.30 * complete + 0.25 * strength) * factor
    conf = F.when(kind == CLASSES[4], F.least(F.lit(0.55), F.greatest(F.lit(0.2), 0.6 * top))).otherwise(clamp(sure, 0.2, 0.99))
    return rows.withColumns({"source": source, "class_confidence": half_up(conf, 3)})


def source_probabilities() -> Column:
    """Map of the seven source types and the five classes to probabilities."""
    v, i, c, p, u = (F.col(f"p_{k}") for k in CLASSES)
    raw = {
        "wildfire": 0.9 * v + 0.1 * c,
        "industrial": 0.85 * i + 0.85 * p,
        "agricultural": c * F.when(F.col("is_agricultural"), 0.65).otherwise(0.2),
        "prescribed_burn": c * F.when(F.col("protected"), 0.7).otherwise(0.15),
        "urban": F.when(F.col("is_urban"), u * 0.15).otherwise(0.01),
        "volcanic": F.lit(0.005),
        "unknown": 0.8 * u,
    }
    floored = {k: F.greatest(F.lit(0.001), x) for k, x in raw.items()}
    total = reduce(lambda a, b: a + b, floored.values())
    sources = [x for k, y in floored.items() for x in (F.lit(k), half_up(y / total, 4))]
    classes = [x for k in CLASSES for x in (F.lit(f"class:{k}"), F.col(f"p_{k}"))]
    return F.create_map(*sources, *classes)


# What drove each class, and how much.
DRIVERS = {
    "vegetation_fire": {"fire_radiative_power": 0.35, "land_cover_vegetation": 0.30, "fire_weather_conditions": 0.20, "satellite_confidence": 0.15},
    "vegetation_fire without weather": {"fire_radiative_power": 0.35, "land_cover_vegetation": 0.30, "satellite_confidence": 0.20, "topographic_slope": 0.15},
    "industrial": {"industrial_proximity": 0.40, "historical_persistence": 0.30, "fire_radiative_power": 0.20, "satellite_confidence": 0.10},
    "controlled_heat_source": {"land_management_status": 0.35, "fire_radiative_power": 0.30, "historical_operational_baseline": 0.20, "weather_stability": 0.15},
    "unknown": {"satellite_confidence": 0.40, "thermal_intensity": 0.30, "unresolved_context": 0.30},
}


def feature_importance() -> Column:
    table = {k: F.create_map(*[F.lit(x) for pair in v.items() for x in pair]) for k, v in DRIVERS.items()}
    kind = F.col("class")
    return (
        F.when((kind == CLASSES[0]) & F.col("has_weather"), table["vegetation_fire"])
        .when(kind == CLASSES[0], table["vegetation_fire without weather"])
        .when(kind.isin(CLASSES[1], CLASSES[3]), table["industrial"])
        .when(kind == CLASSES[2], table["controlled_heat_source"])
        .otherwise(table["unknown"])
    )


def anomaly_zscore(rows: DataFrame, config: Anomaly = Anomaly()) -> DataFrame:
    """Adds is_outlier, outlier_score, deviation against a fixed baseline; sites that always burn need a greater one."""
    z = (F.col("f_frp") - config.mean_frp) / max(1.0, config.std_frp)
    usual = F.coalesce(F.col("prior_30d") >= config.suppress_passes, F.lit(False)) | F.col("recurrent")
    outlier = F.when(usual, z >= config.suppress_sigma).otherwise(z >= config.sigma)
    score = (
        F.when(usual & (z < config.suppress_sigma), clamp(0.10 + 0.04 * z, 0.05, 0.25))
        .when(usual, clamp(0.5 + 0.08 * z, 0.65, 0.95))
        .when(z >= config.sigma, clamp(0.5 + 0.1 * z, 0.65, 0.99))
        .otherwise(F.least(F.lit(0.55), F.greatest(F.lit(0.0), (z + 1) / 5)))
    )
    return rows.withColumns({"is_outlier": outlier, "outlier_score": half_up(score, 3), "deviation": half_up(z, 2)})


def risk(rows: DataFrame, weights: Risk = Risk()) -> DataFrame:
    """Adds the five component scores, risk (0..100) and level to classified rows with anomaly columns."""
    c = F.col
    frp = 100 * c("frp_norm")
    weather = F.coalesce(100 * c("weather_score"), F.lit(25.0))
    most, least = F.greatest("settlement_proximity", "infrastructure_proximity"), F.least("settlement_proximity", "infrastructure_proximity")
    place = F.when(c("has_geo"), clamp(100 * (0.7 * most + 0.2 * least) + F.when(c("protected"), 10.0).otherwise(0.0) + 15 * c("slope_factor"), 0, 100)).otherwise(20.0)
    n30 = F.coalesce("prior_30d", F.lit(0))
    past = F.when(c("recurrent") | (n30 >= 10), 15.0).when(n30 > 0, F.least(F.lit(80.0), 30 + 8.0 * n30)).otherwise(35.0)
    odd = 100 * c("outlier_score")
    on = lambda flag, w: F.when(flag, w).otherwise(0.0)
    w = [F.lit(weights.frp), on(c("has_weather"), weights.weather), on(c("has_geo"), weights.proximity), on(c("has_history"), weights.history), F.lit(weights.anomaly)]
    parts = [frp, weather, place, past, odd]
    mean = reduce(lambda a, b: a + b, (x * y for x, y in zip(parts, w, strict=True))) / reduce(lambda a, b: a + b, w)
    score = mean + 8 * (c("f_confidence") - 0.65)
    score = score * F.when(c("source") == "prescribed_burn", 0.75).when(c("source") == "agricultural", 0.85).otherwise(1.0)
    named = dict(zip(("risk_frp", "risk_weather", "risk_place", "risk_past", "risk_odd"), (half_up(x, 1) for x in parts), strict=True))
    rows = rows.withColumns({**named, "risk": half_up(clamp(score, 0, 100), 1)})
    return rows.withColumn("level", level_of(c("risk")))


def factors() -> Column:
    """Up to four, at least two, reasons for the risk: array of (factor, weight, impact, description), by weight."""
    c = F.col
    item = lambda name, weight, impact, text: F.struct((F.lit(name) if isinstance(name, str) else name).alias("factor"), F.lit(weight).alias("weight"), (F.lit(impact) if isinstance(impact, str) else impact).alias("impact"), F.lit(text).alias("description"))
    power = lambda words: F.format_string(f"{words} (%.1f MW)", c("f_frp"))
    frp = (
        F.when(c("f_frp") >= 100, item(power("Extreme radiative power"), 0.35, "critical", "Energy output of a vigorous fire."))
        .when(c("f_frp") >= 40, item(power("Elevated radiative power"), 0.30, F.when(c("risk") >= 50, "high").otherwise("medium"), "Well above normal variation."))
        .when(c("f_frp") >= 15, item(power("Moderate radiative power"), 0.20, "medium", "Clear thermal signal."))
        .otherwise(item(power("Low radiative power"), 0.15, "low", "Weak thermal signal."))
    )
    wind, dry = F.coalesce("wind", F.lit(0.0)), F.when(F.coalesce("humidity", F.lit(0.0)) == 0, 50.0).otherwise(c("humidity"))
    weather = (
        F.when(~c("has_weather"), item("Weather unknown", 0.10, "low", "No weather data; middling values stand in."))
        .when((wind >= 30) & (dry <= 25), item("Strong wind in dry air", 0.25, "critical", "Fire can spread fast."))
        .when((wind >= 20) | (dry <= 35), item("Wind or dry air", 0.20, "high", "Fire can spread."))
        .otherwise(item("Calm or humid weather", 0.15, "low", "Weather slows spread."))
    )
    town, infra = c("distance_settlement_m"), c("distance_infrastructure_m")
    place = (
        F.when(town <= 2500, item("Settlement nearby", 0.25, F.when(town <= 1200, "critical").otherwise("high"), "People are in reach."))
        .when(infra <= 1000, item("Infrastructure nearby", 0.20, F.when(infra <= 500, "high").otherwise("medium"), "Lines, roads or pipes are in reach."))
        .when(town > 10_000, item("Remote site", 0.15, "low", "No settlement within 10 km."))
    )
    odd = (
        F.when(c("is_outlier") & (c("outlier_score") >= 0.65), item("Radiance far from its baseline", 0.20, F.when(c("outlier_score") >= 0.8, "high").otherwise("medium"), "Deviates from the usual intensity."))
        .when(c("recurrent") | (F.coalesce("prior_30d", F.lit(0)) >= 10), item("Known recurrent source", 0.20, "low", "Seen here again and again."))
    )
    spare = item("Overall profile", 0.20, c("level"), "Weighed from radiance, place and time.")
    found = F.array_compact(F.array(frp, weather, place, odd))
    found = F.when(F.size(found) < 2, F.concat(found, F.array(spare))).otherwise(found)
    keyed = F.transform(found, lambda x, i: F.struct((-x["weight"]).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(keyed), 1, 4), lambda s: s["x"])


def analyzed(rows: DataFrame, config: Anomaly = Anomaly(), weights: Risk = Risk(), outliers: DataFrame | None = None) -> DataFrame:
    """The whole chain over hotspots with context. outliers: (id, is_outlier, outlier_score, deviation) of a population
    model, else the fixed baseline decides."""
    known = classified(features(rows))
    scored = known.join(outliers, "id") if outliers is not None else anomaly_zscore(known, config)
    out = risk(scored, weights)
    return out.withColumns({"factors": factors(), "recommendation": recommendation(F.col("level"), F.col("source")), "probabilities": source_probabilities(), "importance": feature_importance()})


def rationale(config: Anomaly = Anomaly()) -> Column:
    """Why a row of `analyzed` is held usual or odd, of five kinds: a site that always burns (below or above its own bound), radiance above or
    within its baseline, and, where a population was the measure (`population` true), by the forest's score."""
    c = F.col
    usual = F.coalesce(c("prior_30d") >= config.suppress_passes, F.lit(False)) | c("recurrent")
    passes = F.coalesce("prior_30d", F.lit(0))
    return (
        F.when(c("population") & c("is_outlier"), F.format_string("Stands out from the population: score %.3f, %.2f deviations.", "outlier_score", "deviation"))
        .when(c("population"), F.format_string("In line with the population: score %.3f.", "outlier_score"))
        .when(usual & ~c("is_outlier"), F.format_string("Recurrent site (%d passes in 30 days) at its usual radiance.", passes))
        .when(usual, F.format_string("Recurrent site far above its usual radiance: %.2f deviations.", "deviation"))
        .when(c("is_outlier"), F.format_string("Radiance %.1f MW is %.2f deviations above the baseline.", half_up(c("f_frp"), 1), "deviation"))
        .otherwise(F.format_string("Radiance %.1f MW is within the baseline.", half_up(c("f_frp"), 1)))
    )


def batch_analyzed(rows: DataFrame, config: Anomaly = Anomaly(), weights: Risk = Risk()) -> DataFrame:
    """`analyzed` with the batch as population: one forest for all rows, or the fixed baseline for fewer than five rows or such as no forest
    can be fitted on (column `population` tells which), and the rationale. What goes into the forest is computed once."""
    from .forest import population_outliers

    outliers, by_forest = population_outliers(features(rows), config)
    out = analyzed(rows, config, weights, outliers).withColumn("population", F.lit(by_forest))
    return out.withColumn("rationale", rationale(config))
