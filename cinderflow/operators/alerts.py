"""Alerts: generation, ordered deduplication, feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Alerts
from ..functions.common import half_up, title_case
from ..functions.text import recommendation


def severity(level: Column, score: Column, config: Alerts = Alerts()) -> Column:
    chain = F.when((level == "critical") | (score >= config.critical), "critical").when((level == "high") | (score >= config.warning), "warning")
    return chain.when((level == "medium") | (score >= config.info), "info") if config.include_medium else chain


def severity_rank(column: Column) -> Column:
    return F.when(column == "critical", 3).when(column == "warning", 2).otherwise(1)


def alert_id(incident: Column, suffix: str | None = None) -> Column:
    bare = F.regexp_replace(incident, "^INC-", "")
    made = F.when(bare.startswith("ALT-"), bare).otherwise(F.concat(F.lit("ALT-"), bare))
    return F.concat(made, F.lit(f"-{suffix}")) if suffix else made


def from_hotspots(rows: DataFrame, config: Alerts = Alerts()) -> DataFrame:
    """One alert for each hotspot grave enough. Context columns (distance_settlement_m, is_protected, wind, gust, cardinal,
    humidity, last_updated) may be missing; a zero distance or wind counts as unknown."""
    kinds = {"distance_settlement_m": "double", "is_protected": "boolean", "wind": "double", "gust": "double", "cardinal": "string", "humidity": "double", "nearest_place": "string", "last_updated": "string"}
    absent = {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in rows.columns}
    rows = rows.withColumns(absent) if absent else rows
    c = F.col
    town, wind = F.nullif(c("distance_settlement_m"), F.lit(0.0)), F.nullif(c("wind"), F.lit(0.0))
    place = F.coalesce("nearest_place", F.format_string("Coordinates (%.3f, %.3f)", "latitude", "longitude"))
    source, sev = c("source_type"), severity(c("risk_level"), c("risk_score"), config)
    close = F.coalesce(town <= 2000, F.lit(False))
    head = (
        F.when((sev == "critical") & (source == "wildfire") & close, "Fast wildfire near settlement")
        .when((sev == "critical") & (source == "wildfire"), "Intense wildfire")
        .when((sev == "critical") & (source == "industrial"), "Unusual industrial surge")
        .when((sev == "critical") & (source == "volcanic"), "Major volcanic outlier")
        .when(sev == "critical", "Critical thermal anomaly")
        .when((sev == "warning") & (source == "wildfire"), "Active wildland anomaly")
        .when((sev == "warning") & (source == "industrial"), "Elevated stack radiance")
        .when((sev == "warning") & (source == "volcanic"), "Elevated volcanic activity")
        .when(sev == "warning", F.concat(F.lit("High risk: "), title_case(source)))
        .otherwise(F.concat(F.lit("Notice: "), title_case(source)))
    )
    wind_text = F.concat(F.format_string("Wind %.1f km/h", half_up(wind, 1)), F.coalesce(F.concat(F.lit(" "), c("cardinal")), F.lit("")), F.when(c("gust") > wind, F.format_string(", gusts %.1f km/h", half_up(c("gust"), 1))).otherwise(""), F.lit("."))
    message = F.concat_ws(" ", F.format_string("FRP %.1f MW.", half_up(c("frp"), 1)), F.when(town.isNotNull(), F.format_string("Settlement at %.1f km.", half_up(town / 1000, 1))), F.when(wind.isNotNull(), wind_text), F.when(c("humidity") <= 20, F.format_string("Very dry air (%.0f %%).", half_up(c("humidity"), 0))))
    tags = F.array_compact(F.array(source, F.when(c("is_protected"), "protected_area"), F.when(c("frp") >= 100, "critical_frp"), F.when(c("is_anomaly"), "statistical_anomaly"), F.when(close, "settlement_proximity"), F.when(wind >= 30, "high_wind")))
    return rows.select(
        alert_id(c("id")).alias("id"), c("id").alias("hotspot_id"), sev.alias("severity"), F.concat(head, F.lit(" - "), place).alias("title"), message.alias("message"),
        half_up(c("risk_score"), 1).alias("risk_score"), place.alias("location_name"), "latitude", "longitude",
        F.coalesce("last_updated", F.concat(c("acq_date"), F.lit("T"), F.substring("acq_time", 1, 2), F.lit(":"), F.substring("acq_time", 3, 2), F.lit(":00Z"))).alias("timestamp"),
        F.lit(False).alias("is_acknowledged"), recommendation(c("risk_level"), source).alias("recommended_action"), tags.alias("tags"),
    ).where("severity is not null")


def from_incidents(incidents: DataFrame, hotspots: DataFrame, config: Alerts = Alerts()) -> DataFrame:
    """The primary hotspot's alert with the incident's id, risk and centre; a generic one if that hotspot isn't there."""
    own = from_hotspots(hotspots, Alerts(config.critical, config.warning, config.info, True)).select(F.col("hotspot_id").alias("primary_id"), "title", "message", "tags", "recommended_action")
    c = F.col
    generic = F.when(c("risk_level") == "critical", "critical").when(c("risk_level") == "high", "warning")
    generic = generic.when(c("risk_level") == "medium", "info") if config.include_medium else generic
    joined = incidents.join(own, "primary_id", "left")
    sev = F.when(c("title").isNotNull(), severity(c("risk_level"), c("risk_score"), config)).otherwise(generic)
    return joined.select(
        alert_id(c("incident_id")).alias("id"), c("primary_id").alias("hotspot_id"), sev.alias("severity"),
        F.coalesce("title", F.concat(F.lit("Incident: "), title_case(c("source_type")))).alias("title"),
        F.coalesce("message", F.format_string("%d detections, peak FRP %.1f MW.", "n", half_up(c("peak_frp"), 1))).alias("message"),
        half_up(c("risk_score"), 1).alias("risk_score"), F.lit(None).cast("string").alias("location_name"), "latitude", "longitude", c("last_seen").alias("timestamp"),
        F.lit(False).alias("is_acknowledged"), F.coalesce("recommended_action", F.lit("Monitor the area of the cluster.")).alias("recommended_action"),
        F.coalesce("tags", F.array(c("source_type"), F.lit("aggregated_incident"))).alias("tags"),
    ).where("severity is not null")


#: Rows of one (hotspot_id, severity) are dealt into this many parts before their partial results meet.
SALTS = 16


def deduplicated(alerts: DataFrame, order: str, salts: int = SALTS) -> DataFrame:
    """What is left of the alerts of one (hotspot_id, severity), folded in `order`:

    an acknowledged one gives way to a graver new one, which stays acknowledged; a new one gives way to an acknowledged
    one; else the strictly graver wins. So once one is acknowledged all before it is forgotten: the fold is the gravest from the first
    acknowledged one on (from the beginning, if none is), the earlier of equals, acknowledged if any was. That is two aggregates whose
    partial results merge in any order: the first acknowledged one, then the gravest not before it, by key and part and then by key.

    An unknown risk is below all others, an unknown acknowledgement is none; rows of equal order go by their other values.
    """
    keys = ["hotspot_id", "severity"]
    others = [c for c in alerts.columns if c not in keys]
    risk = F.coalesce(F.col("risk_score"), F.lit(float("-inf")))
    rows = alerts.select(*keys, F.struct(F.col(order).alias("__o"), *others).alias("item"), (-risk).alias("less"), F.coalesce("is_acknowledged", F.lit(False)).alias("known"))
    first = rows.where("known").groupBy(*(F.col(k).alias(f"f_{k}") for k in keys)).agg(F.min("item").alias("since"))
    first = first.withColumn("f_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in (*keys, "part")))
    parted = rows.withColumn("part", F.pmod(F.xxhash64("item.__o"), F.lit(salts)).cast("int"))
    from_it = parted.join(first, same, "left").where("since is null or item >= since")
    gravest = F.min(F.struct("less", "item")).alias("best")
    partial = from_it.groupBy(*keys, "part").agg(gravest, F.bool_or(F.col("since").isNotNull()).alias("known"))
    whole = partial.groupBy(*keys).agg(F.min("best").alias("best"), F.bool_or("known").alias("known"))
    return whole.select(*(F.col("known").alias(c) if c == "is_acknowledged" else c if c in keys else F.col(f"best.item.{c}").alias(c) for c in alerts.columns))


def priority(prefix: str = "") -> Column:
    """What alerts are compared by: severity, risk, time, id; the greater struct is the more urgent alert. (A list breaks ties of all but
    the id by the lesser id instead: `feed`.)"""
    c = lambda name: F.col(f"{prefix}{name}")
    when = F.coalesce(F.unix_timestamp(F.try_to_timestamp(c("timestamp"))), F.lit(0))
    return F.struct(severity_rank(c("severity")).alias("severity"), c("risk_score").alias("risk"), when.alias("at"), c("id").alias("id"))


def compared(a: str, b: str) -> Column:
    """1, -1 or 0: whether the alert in the columns that begin with `a` goes before that of `b`, after it, or is the same."""
    return F.when(priority(a) > priority(b), 1).when(priority(a) < priority(b), -1).otherwise(0)


def incident_feed(incidents: DataFrame, hotspots: DataFrame, config: Alerts = Alerts()) -> DataFrame:
    """The alerts of incidents, those of one hotspot and severity folded, the gravest first."""
    return feed(deduplicated(from_incidents(incidents, hotspots, config), "id"))


def feed(alerts: DataFrame, severity_is: str | None = None, unread_only: bool = False, limit: int | None = None) -> DataFrame:
    """Filtered after deduplication, the gravest first: severity, risk, time, id."""
    if severity_is:
        alerts = alerts.where(F.col("severity") == severity_is)
    if unread_only:
        alerts = alerts.where(~F.col("is_acknowledged"))
    when = F.coalesce(F.unix_timestamp(F.try_to_timestamp("timestamp")), F.lit(0))
    ordered = alerts.orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("risk_score"), F.desc(when), "id")
    return ordered.limit(limit) if limit else ordered


def unread(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(~F.col("is_acknowledged")).alias("unread"))


def acknowledged(alerts: DataFrame, alert: str) -> DataFrame:
    return alerts.withColumn("is_acknowledged", F.when(F.col("id") == alert, True).otherwise(F.col("is_acknowledged")))


def orphans(alerts: DataFrame, hotspots: DataFrame) -> DataFrame:
    """Alerts whose hotspot isn't there."""
    return alerts.join(hotspots.select(F.col("id").alias("hotspot_id")), "hotspot_id", "left_anti").select(*alerts.columns)
