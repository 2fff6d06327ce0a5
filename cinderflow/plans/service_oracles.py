"""SQL (DuckDB) for `service_queries`."""

from __future__ import annotations

from .oracles import ALERTS, COMPASS, LAT, LON, ORACLES, SCORING, WEATHER, H, fwi, up

SERVICE: dict[str, str] = {}
SERVICE["service_health"] = f"WITH {H} SELECT 'ok' AS status, 'live' AS data_mode, max(acq_date || 'T' || acq_time) AS last_sync FROM h"
SERVICE["service_hotspots"] = f"WITH {H}, m AS (SELECT *, count(*) OVER () AS total FROM h WHERE risk_level = 'high' AND frp >= 20 AND NOT is_anomaly) SELECT id, frp, acq_date, acq_time, total, 'live' AS data_mode FROM m ORDER BY frp DESC, acq_date DESC, acq_time DESC, id LIMIT 100 OFFSET 100"


def advice(level: str, source: str) -> str:
    return f"""CASE WHEN {level} = 'critical' AND {source} = 'wildfire' THEN 'Critical: send air and ground crews now and prepare evacuation within 5 km.' WHEN {level} = 'critical' AND {source} = 'industrial' THEN 'Critical: call hazardous-materials response and the site''s emergency manager.'
 WHEN {level} = 'critical' THEN 'Critical: send a field team to verify the source and secure the perimeter.' WHEN {level} = 'high' AND {source} = 'wildfire' THEN 'High: inform the regional duty officer, task the next overpass, ready suppression.' WHEN {level} = 'high' AND {source} = 'industrial' THEN 'High: compare with the site''s permits and ask the plant for its status.'
 WHEN {level} = 'high' THEN 'High: plan a surveillance flight and check local sensors.' WHEN {level} = 'medium' THEN 'Routine: keep tracking; look up burn permits of the district.' ELSE 'Log only: consistent with normal operations.' END"""


SEEN = "acq_date || 'T' || acq_time[1:2] || ':' || acq_time[3:4] || ':00Z'"
SAW = f"printf('%s saw %.1f MW', satellite, {up('frp', 1)})"
SERVICE["service_detail"] = f"""WITH {SCORING}, y AS (SELECT *, event_id % 60 <> 0 AS gk, event_id % 8 <> 0 AS wk, event_id % 10 <> 9 AS hk FROM s WHERE event_id = 12) SELECT id, CASE WHEN gk THEN land_cover ELSE 'unclassified_terrain' END AS land_cover, CASE WHEN wk THEN temp ELSE 24.0::double END AS temperature,
 CASE WHEN wk THEN NULL ELSE 'S' END AS cardinal, (CASE WHEN hk THEN n30 ELSE 0 END)::bigint AS prior_30d, hk AS historical_known, {advice("risk_level", "source_type")} AS recommendation, {SEEN} AS seen, {SAW} AS event FROM y"""
SERVICE["service_summary"] = f"SELECT * FROM ({ORACLES['kpi_summary']}), ({ORACLES['alerts_unread']})"
SERVICE["service_sources"] = ORACLES["source_breakdown"]
SERVICE["service_alerts"] = f"WITH {ALERTS} SELECT id, hotspot_id, risk_score, timestamp, (SELECT count(*) FROM de WHERE NOT is_acknowledged) AS unread FROM de WHERE severity = 'critical' AND NOT is_acknowledged"
SERVICE["service_acknowledge"] = f"WITH {ALERTS} SELECT id, is_acknowledged OR event_id = 17 AS is_acknowledged, 1::bigint AS done FROM (SELECT *, seq AS event_id FROM al)"
SERVICE["service_generate"] = f"WITH {H} SELECT 'ALT-' || id AS id, id AS hotspot_id, CASE WHEN risk_level = 'critical' OR risk_score >= 75 THEN 'critical' ELSE 'warning' END AS severity, {up('risk_score', 1)} AS risk_score FROM h WHERE risk_level IN ('critical', 'high') OR risk_score >= 50"
SERVICE["service_refresh"] = f"WITH k AS (SELECT count(DISTINCT id) AS n FROM ({ORACLES['ingest_normalize']})) SELECT run::bigint AS run, 'success' AS status, n AS ingested, n AS stored, n AS ids FROM k, (VALUES (1), (2)) v(run)"
SERVICE["service_clear"] = "SELECT count(*) AS cleared, 0::bigint AS left, true AS seeded_0, false AS seeded_1, count(*) AS total, 'demo' AS data_mode FROM events"
SERVICE["ingest_landing"] = f"SELECT *, 'live' AS data_mode FROM ({ORACLES['ingest_normalize']})"
SERVICE["ingest_records"] = ORACLES["ingest_normalize"]
SERVICE["input_normalize"] = f"""WITH l AS (SELECT *, event_id AS e, regexp_extract(props, '([0-9]+)', 1)::double AS k, {LAT} AS lat, {LON} AS lon, CASE WHEN event_id % 4 = 1 AND value * 0.4::double <> -300 THEN 300.0::double + value * 0.4::double WHEN event_id % 8 < 6 THEN 301.0::double + value * 0.4::double ELSE 310.0::double END AS b FROM events),
c AS (SELECT *, CASE e % 7 WHEN 0 THEN 0.95::double WHEN 1 THEN 0.35::double WHEN 3 THEN CASE WHEN k > 1 THEN least(k / 100, 1.0::double) ELSE k END WHEN 4 THEN CASE WHEN k / 100 > 1 THEN least(k / 100 / 100, 1.0::double) ELSE k / 100 END ELSE 0.65::double END AS score FROM l)
SELECT CASE WHEN e % 3 = 0 THEN 'A' || e::varchar WHEN e % 3 = 1 THEN 'B' || e::varchar WHEN e % 2 = 0 THEN 'C' || e::varchar ELSE 'UNKNOWN-HOTSPOT' END AS id, CASE WHEN e % 11 IN (0, 1, 2) THEN 0.0::double ELSE greatest(value, 0.0::double) END AS frp, greatest(b, 0.0::double) AS brightness,
 CASE WHEN score >= 0.8::double THEN 'high' WHEN score < 0.4::double THEN 'low' ELSE 'nominal' END AS confidence, score AS confidence_score, CASE WHEN e % 2 = 0 THEN 'Terra' ELSE 'VIIRS' END AS satellite, 'VIIRS' AS instrument, CASE WHEN e % 13 <> 0 THEN lat END AS latitude, CASE WHEN e % 13 <> 1 THEN lon END AS longitude,
 CASE e % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'N' END AS daynight FROM c"""
SERVICE["context_names"] = f"WITH {SCORING} SELECT id, land_cover, d_set AS distance_settlement_m, d_inf AS distance_infrastructure_m, prot AS is_protected, slope, temp AS temperature, rh AS humidity, wind, fwi, n30 AS prior_30d, n90 AS prior_90d, rec AS is_recurrent, pers AS persistence FROM s"
SERVICE["chart_sources"] = f"SELECT source_type, trim(split_part(label, '/', 1)) AS name, n, floor(avg_frp + 0.5::double)::bigint AS avg_frp FROM ({ORACLES['source_breakdown']})"
SERVICE["chart_peaks"] = f"WITH {H} SELECT split_part(id, '-', 2) AS tail, frp, risk_score AS risk, split_part(nearest_place, ',', 1) AS place FROM h ORDER BY frp DESC, id LIMIT 6"
SERVICE["alert_texts"] = f"""WITH {SCORING}, a AS (SELECT *, CASE WHEN risk_level = 'critical' OR risk_score >= 75 THEN 'critical' WHEN risk_level = 'high' OR risk_score >= 50 THEN 'warning' WHEN risk_level = 'medium' OR risk_score >= 25 THEN 'info' END AS sev, coalesce(d_set > 0 AND d_set <= 2000, false) AS close, upper(source_type[1]) || source_type[2:] AS cased FROM s)
SELECT 'ALT-' || id AS id, CASE sev WHEN 'critical' THEN CASE source_type WHEN 'wildfire' THEN CASE WHEN close THEN 'Fast wildfire near settlement' ELSE 'Intense wildfire' END WHEN 'industrial' THEN 'Unusual industrial surge' WHEN 'volcanic' THEN 'Major volcanic outlier' ELSE 'Critical thermal anomaly' END
 WHEN 'warning' THEN CASE source_type WHEN 'wildfire' THEN 'Active wildland anomaly' WHEN 'industrial' THEN 'Elevated stack radiance' WHEN 'volcanic' THEN 'Elevated volcanic activity' ELSE 'High risk: ' || cased END ELSE 'Notice: ' || cased END || ' - ' || nearest_place AS title,
 concat_ws(' ', printf('FRP %.1f MW.', {up('frp', 1)}), CASE WHEN d_set > 0 THEN printf('Settlement at %.1f km.', floor(d_set / 100 + 0.5::double) / 10) END, CASE WHEN wind > 0 THEN printf('Wind %.1f km/h.', wind) END, CASE WHEN rh <= 20 THEN printf('Very dry air (%.0f %%).', rh) END) AS message,
 nearest_place AS location_name, {advice("risk_level", "source_type")} AS recommended_action, array_to_string(list_filter([source_type, CASE WHEN prot THEN 'protected_area' END, CASE WHEN frp >= 100 THEN 'critical_frp' END, CASE WHEN is_anomaly THEN 'statistical_anomaly' END, CASE WHEN close THEN 'settlement_proximity' END, CASE WHEN wind >= 30 THEN 'high_wind' END], lambda x: x IS NOT NULL)[1:3], ',') AS first_tags FROM a WHERE sev IS NOT NULL"""
SERVICE["alert_references"] = f"WITH {H} SELECT 'ALT-' || id AS id, CASE WHEN risk_score >= 75 THEN 'critical' ELSE 'warning' END AS severity FROM h WHERE risk_level <> 'critical' AND (risk_level = 'high' OR risk_score >= 50)"
R_LEVEL = ORACLES["risk_score"].split(" SELECT id,")[0]
SERVICE["rationales"] = f"""{R_LEVEL}, v AS (SELECT *, CASE WHEN risk >= 75 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS level FROM r) SELECT id, CASE WHEN usual AND NOT is_outlier THEN printf('Recurrent site (%d passes in 30 days) at its usual radiance.', coalesce(n30, 0)) WHEN usual THEN printf('Recurrent site far above its usual radiance: %.2f deviations.', deviation)
 WHEN is_outlier THEN printf('Radiance %.1f MW is %.2f deviations above the baseline.', {up('frp', 1)}, deviation) ELSE printf('Radiance %.1f MW is within the baseline.', {up('frp', 1)}) END AS rationale, {advice("level", "source")} AS recommendation FROM v"""
FWI = fwi("temperature", "humidity", "wind", "gust", "rain")
SERVICE["weather_texts"] = f"""WITH {H}, {WEATHER}, w AS (SELECT DISTINCT ON (glat, glon) glat, glon, temperature, least(greatest(humidity, 0), 100)::double AS humidity, wind, gust, direction, rain FROM w0), j AS (SELECT id, temperature, humidity, wind, {FWI} AS f, {COMPASS} AS card FROM h LEFT JOIN w ON floor(latitude * 100 + 0.5) = glat AND floor(longitude * 100 + 0.5) = glon)
SELECT id, coalesce(temperature, 0.0::double) AS temperature, coalesce(humidity, 0.0::double) AS humidity, coalesce(wind, 0.0::double) AS wind, CASE WHEN temperature IS NULL THEN 0.0::double ELSE f END AS fwi, CASE WHEN temperature IS NULL THEN 'N/A' ELSE card END AS cardinal,
 CASE WHEN temperature IS NOT NULL THEN CASE WHEN f >= 80 THEN 'Critical fire weather' WHEN f >= 60 THEN 'Elevated fire danger' WHEN f >= 35 THEN 'Moderate conditions' ELSE 'Low hazard' END || printf(': %.1f C, humidity %.0f %%, wind %.1f km/h %s', temperature, humidity, wind, card) END AS forecast FROM j"""
SERVICE["timelines"] = f"WITH {H} SELECT id, {SEEN} AS timestamp, 'detection' AS type, {SAW} AS summary, confidence FROM h"
AGO = "(epoch(TIMESTAMP '2024-01-20 12:00:00') - epoch(strptime(acq_date || acq_time, '%Y-%m-%d%H%M')))::bigint"
SERVICE["display_units"] = f"""WITH {SCORING}, d AS (SELECT *, {AGO} AS sec FROM s) SELECT id, printf('%.4f°%s, %.4f°%s', abs(latitude), CASE WHEN latitude >= 0 THEN 'N' ELSE 'S' END, abs(longitude), CASE WHEN longitude >= 0 THEN 'E' ELSE 'W' END) AS place, CASE WHEN d_set IS NULL THEN 'N/A' WHEN d_set < 1000 THEN printf('%d m', d_set::bigint) ELSE printf('%.1f km', floor(d_set / 1000 * 10 + 0.5::double) / 10) END AS settlement,
 printf('%.1f MW', {up("frp", 1)}) AS power, CASE WHEN temp IS NULL THEN '—' ELSE printf('%.1f°C', temp) END AS temperature, strftime(strptime(acq_date || acq_time, '%Y-%m-%d%H%M'), '%b %-d, %H:%M:%S') AS seen, CASE WHEN sec < 60 THEN 'just now' WHEN sec < 3600 THEN (sec // 60)::varchar || 'm ago' WHEN sec < 86400 THEN (sec // 3600)::varchar || 'h ago' ELSE (sec // 86400)::varchar || 'd ago' END AS ago FROM d"""
SERVICE["display_labels"] = f"""WITH {H} SELECT upper(risk_level) AS level, CASE source_type WHEN 'wildfire' THEN 'Wildfire' WHEN 'industrial' THEN 'Industrial Facility' WHEN 'agricultural' THEN 'Agricultural Burn' WHEN 'urban' THEN 'Urban / Structure' WHEN 'volcanic' THEN 'Volcanic Activity' ELSE 'Unknown Source' END AS source,
 CASE source_type WHEN 'wildfire' THEN 'Rapidly spreading wildland vegetative fire' WHEN 'industrial' THEN 'Petrochemical refinery or flare stack emission' WHEN 'agricultural' THEN 'Seasonal field clearing or stubble burning' WHEN 'urban' THEN 'Commercial or dense urban footprint thermal mass' WHEN 'volcanic' THEN 'Active crater or caldera lava effusion' ELSE 'Unclassified thermal radiation signature' END AS description,
 CASE WHEN risk_level = 'critical' OR risk_score >= 75 THEN 'CRITICAL' WHEN risk_level = 'high' OR risk_score >= 50 THEN 'WARNING' ELSE 'ADVISORY' END AS severity, count(*) AS n, {up('max(frp)', 2)} AS most FROM h GROUP BY ALL"""
