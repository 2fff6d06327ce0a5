"""Queries of the service over its store, of landed files and of texts shown to people; `service_oracles` has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.common import half_up
from ..operators import alerts, dossier, enrich, intelligence, summary
from ..operators.filters import HotspotFilter
from ..sources import context, ingest
from . import testdata as T
from .api import Service
from .lineage import work_path

RUN_DATE = "2024-02-01"
SYNCED = "2024-02-01T00:00:00Z"
SCALARS = ["id", "latitude", "longitude", "brightness", "acq_date", "acq_time", "satellite", "instrument", "confidence", "frp", "daynight", "risk_score", "risk_level", "is_anomaly"]
DETAILS = ["id", "land_cover", "temperature", "humidity", "wind", "prior_30d", "prior_90d", "is_recurrent"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def filled(spark: SparkSession, sf: str) -> Service:
    """A service whose store holds the whole stand-in tables: hotspots, alerts, details of one detection in three, and the last sync."""
    service = Service(spark, work_path(spark, "service"))
    rows = T.hotspots(spark, sf).withColumn("data_mode", F.lit("live"))
    details = T.scoring_input(spark, sf).where("event_id % 3 = 0").select(*DETAILS)
    last = rows.agg(F.lit("last_sync").alias("key"), F.max(F.concat_ws("T", "acq_date", "acq_time")).alias("value"))
    mode = rows.agg(F.lit("data_mode").alias("key"), F.max("data_mode").alias("value"))
    service.seed({"hotspots": rows, "alerts": T.alert_rows(spark, sf), "details": details, "meta": last.unionByName(mode)})
    return service


@query
def service_health(spark, sf):
    return filled(spark, sf).health()


@query
def service_hotspots(spark, sf):
    """The second page of matches, each row with the number of all matches."""
    rows, total = filled(spark, sf).hotspots(HotspotFilter(risk_level="high", min_frp=20.0, is_anomaly=False), 2, 100)
    return rows.select("id", "frp", "acq_date", "acq_time").join(F.broadcast(total))  # one row


@query
def service_detail(spark, sf):
    """The dossier of one detection."""
    rows = filled(spark, sf).detail("EV-000000012")
    event = F.col("timeline")[0]
    return rows.select("id", "land_cover", "temperature", "cardinal", F.col("prior_30d").cast("long").alias("prior_30d"), "historical_known", "recommendation", event["timestamp"].alias("seen"), event["summary"].alias("event"))


@query
def service_summary(spark, sf):
    """The key figures with the number of alerts that nobody has seen."""
    return filled(spark, sf).summary().drop("source_counts")


@query
def service_sources(spark, sf):
    return filled(spark, sf).sources()


@query
def service_alerts(spark, sf):
    """The whole feed of new critical alerts, each with the number of all unread ones."""
    service = filled(spark, sf)
    rows, unread = service.alerts("critical", True)
    return rows.select("id", "hotspot_id", "risk_score", "timestamp").join(F.broadcast(unread))  # one row


@query
def service_acknowledge(spark, sf):
    """The alerts that the store holds after two were acknowledged, one of them unknown."""
    service = filled(spark, sf)
    done = [service.acknowledge(x) for x in ("ALT-17", "ALT-none")]
    return service._table("alerts").select("id", "is_acknowledged", F.lit(done.count(True)).cast("long").alias("done"))


@query
def service_generate(spark, sf):
    """The alert table that is made from the stored hotspots."""
    service = filled(spark, sf)
    service.generate_alerts()
    return service._table("alerts").select("id", "hotspot_id", "severity", "risk_score")


@query
def service_refresh(spark, sf):
    """Two refreshes of one feed, first from a cache, since the live source is silent, then live: what each says, and the rows stored then."""
    service = Service(spark, work_path(spark, "service"))
    raw = T.raw_rows(spark, sf).drop("event_id")
    said = []
    for k, chain in enumerate(([(None, "live", ""), (raw, "cache", "cached")], [(raw, "live", "fetched"), (raw, "demo", "sample")])):
        row = service.refresh(chain, RUN_DATE, SYNCED)
        stored = service._table("hotspots").agg(F.count("*").alias("stored"), F.count_distinct("id").alias("ids"))
        said.append(row.select(F.lit(k + 1).cast("long").alias("run"), "status", "ingested").join(F.broadcast(stored)))
    return said[0].unionByName(said[1])


@query
def service_clear(spark, sf):
    """How many hotspots there were before the store was emptied, and are after it; and whether an empty store is seeded again, a full one not."""
    service = filled(spark, sf)
    cleared = service.clear()
    left = service.hotspots()[1].select(F.col("total").alias("left"))
    rows = {"hotspots": T.hotspots(spark, sf).withColumn("data_mode", F.lit("demo"))}
    seeded = [service.seed(rows), service.seed(rows)]
    after = service.hotspots()[1].select("total", "data_mode")
    return left.join(F.broadcast(after)).select(F.lit(cleared).cast("long").alias("cleared"), "left", *(F.lit(x).alias(f"seeded_{k}") for k, x in enumerate(seeded)), "total", "data_mode")


@query
def ingest_landing(spark, sf):
    """Detections landed as CSV, taken by the chain of sources after a landing that holds error pages."""
    pages, rows = work_path(spark, "landing-pages"), work_path(spark, "landing-csv")
    T.payloads(spark, sf).where("payload like '<html>%'").select("payload").write.text(pages)
    T.raw_rows(spark, sf).drop("event_id").write.option("header", True).csv(rows)
    chain = [(ingest.landed_csv(spark, pages), "live", "fetched"), (ingest.landed_csv(spark, rows), "cache", "cached")]
    return ingest.normalized(ingest.fallback(chain)[0], RUN_DATE, keep=("data_mode",)).select(*SCALARS, "data_mode")


@query
def ingest_records(spark, sf):
    """Detections landed as JSON records, a record a line."""
    path = work_path(spark, "landing-json")
    T.raw_rows(spark, sf).drop("event_id").write.json(path)
    return ingest.normalized(ingest.read_json(spark, path, lines=True), RUN_DATE).select(*SCALARS)


@query
def input_normalize(spark, sf):
    """The engine's view of detections in any shape."""
    return intelligence.input_normalized(T.loose_rows(spark, sf))


@query
def context_names(spark, sf):
    """Contexts written as JSON details and read back under other names than they are used by."""
    c = F.col
    rows = T.scoring_input(spark, sf).select(
        "id",
        F.struct("land_cover", c("distance_settlement_m").alias("distance_to_settlement_meters"), c("distance_infrastructure_m").alias("distance_to_infrastructure_meters"), c("is_protected").alias("is_protected_area"), c("slope").alias("slope_degrees")).alias("geospatial"),
        F.struct(c("temperature").alias("temperature_celsius"), c("humidity").alias("relative_humidity_percent"), c("wind").alias("wind_speed_kmh"), c("fwi").alias("fire_weather_index")).alias("weather"),
        F.struct(c("prior_30d").alias("prior_detections_30d"), c("prior_90d").alias("prior_detections_90d"), c("is_recurrent").alias("is_recurrent_site"), c("persistence").alias("detection_frequency_score")).alias("historical"),
    )
    return context.resolved(context.decoded(context.encoded(rows))).select("id", "land_cover", "distance_settlement_m", "distance_infrastructure_m", "is_protected", "slope", "temperature", "humidity", "wind", "fwi", "prior_30d", "prior_90d", "is_recurrent", "persistence")


@query
def chart_sources(spark, sf):
    return summary.chart_sources(T.hotspots(spark, sf))


@query
def chart_peaks(spark, sf):
    return summary.chart_peaks(T.hotspots(spark, sf))


@query
def alert_texts(spark, sf):
    """Titles, messages, places and advice of all alerts, those of medium risk included."""
    rows = T.scoring_input(spark, sf)
    return alerts.from_hotspots(rows, alerts.Alerts(include_medium=True)).select("id", "title", "message", "location_name", "recommended_action", F.array_join(F.slice("tags", 1, 3), ",").alias("first_tags"))


@query
def alert_references(spark, sf):
    """Alerts whose hotspot is no longer there, after those that aren't critical are gone."""
    rows = T.hotspots(spark, sf)
    return alerts.orphans(alerts.from_hotspots(rows), rows.where("risk_level = 'critical'")).select("id", "severity")


@query
def rationales(spark, sf):
    """Why each detection is held usual or odd against the fixed baseline, and the advice."""
    rows = intelligence.analyzed(T.scoring_input(spark, sf)).withColumn("population", F.lit(False))
    return rows.select("id", intelligence.rationale().alias("rationale"), "recommendation")


@query
def weather_texts(spark, sf):
    """The weather of each detection as it is shown: zeros where it is unknown, and a forecast where it isn't."""
    rows = enrich.presented(enrich.weather_context(T.hotspots(spark, sf), T.weather(spark, sf), first_by="station"))
    return rows.select("id", "temperature", "humidity", "wind", "fwi", "cardinal", "forecast")


@query
def timelines(spark, sf):
    """The events of each dossier."""
    rows = dossier.dossiers(T.hotspots(spark, sf).drop("land_cover"), T.scoring_input(spark, sf).where("event_id % 3 = 0").select(*DETAILS))
    return rows.select("id", F.explode("timeline").alias("e")).select("id", "e.timestamp", "e.type", "e.summary", F.col("e.details")["confidence"].alias("confidence"))


@query
def display_units(spark, sf):
    """Positions, distances, powers, temperatures and times as they are shown."""
    rows = T.scoring_input(spark, sf)
    seen = F.to_timestamp(F.concat_ws(" ", "acq_date", "acq_time"), "yyyy-MM-dd HHmm")
    return rows.select(
        "id", text.coordinates(F.col("latitude"), F.col("longitude"), "°").alias("place"), text.distance(F.col("distance_settlement_m")).alias("settlement"), text.megawatts(F.col("frp")).alias("power"), text.celsius(F.col("temperature")).alias("temperature"),
        text.timestamp(F.date_format(seen, "yyyy-MM-dd'T'HH:mm:ss")).alias("seen"), text.relative_time(seen, F.lit("2024-01-20 12:00:00").cast("timestamp")).alias("ago"),
    )


@query
def display_labels(spark, sf):
    """How many detections have each label of level, source and severity."""
    rows = T.hotspots(spark, sf)
    severity = alerts.severity(F.col("risk_level"), F.col("risk_score"))
    labels = rows.select(text.level_label(F.col("risk_level")).alias("level"), text.source_label(F.col("source_type")).alias("source"), text.source_description(F.col("source_type")).alias("description"), text.severity_label(severity).alias("severity"), "frp")
    return labels.groupBy("level", "source", "description", "severity").agg(F.count("*").alias("n"), half_up(F.max("frp"), 2).alias("most"))
