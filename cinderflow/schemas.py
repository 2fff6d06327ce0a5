"""Row types of the domain, as DDL: they can be read before a session is there."""

from __future__ import annotations

HOTSPOT = (
    "id string, latitude double, longitude double, brightness double, scan double, track double, acq_date string, acq_time string, "
    "satellite string, instrument string, confidence string, version string, bright_t31 double, frp double, daynight string, "
    "source_type string, risk_score double, risk_level string, is_anomaly boolean, cluster_id string, cluster_size int, "
    "nearest_place string, last_updated string"
)
FEATURE = ("id string, name string, category string, feature_type string, latitude double, longitude double, tags map<string,string>")
OSM_ELEMENT = "array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, bounds: struct<minlat: double, minlon: double, maxlat: double, maxlon: double>, tags: map<string, string>>>"
ALERT = (
    "id string, hotspot_id string, severity string, title string, message string, risk_score double, location_name string, latitude double, "
    "longitude double, timestamp string, is_acknowledged boolean, recommended_action string, tags array<string>"
)
