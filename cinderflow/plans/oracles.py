"""SQL (DuckDB) for the queries' results, written apart from the DataFrame code."""

from __future__ import annotations


def up(x: str, places: int) -> str:
    s = f"{10**places}.0::double"
    return f"floor(({x}) * {s} + 0.5::double) / {s}"


def clamp(x: str, low: str, high: str) -> str:
    return f"least(greatest({x}, {low}::double), {high}::double)"


def level(x: str) -> str:
    return f"CASE WHEN {x} >= 75 THEN 'critical' WHEN {x} >= 50 THEN 'high' WHEN {x} >= 25 THEN 'medium' ELSE 'low' END"


def meters(a: str, b: str, c: str, d: str) -> str:
    h = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    h = clamp(h, "0", "1")
    return f"CASE WHEN {a} = {c} AND {b} = {d} THEN 0.0::double ELSE 2 * 6371000.0::double * atan2(sqrt({h}), sqrt(1 - {h})) END"


LAT = "30.0::double + (user_id % 50) * 0.05::double + ((event_id % 11) - 5) * 0.001::double"
LON = "-120.0::double + floor(user_id / 50) * 0.05::double + ((event_id % 7) - 3) * 0.001::double"
BASE = """
base AS (SELECT *, greatest(value, 0.0::double) AS frp0, 300.0::double + value * 0.4::double AS bright FROM events),
scored AS (SELECT *, CASE WHEN frp0 >= 100 OR bright >= 355 THEN 'critical' WHEN frp0 >= 50 OR bright >= 340 THEN 'high' WHEN frp0 >= 20 OR bright >= 325 THEN 'medium' ELSE 'low' END AS lvl FROM base)
"""
SCORE = up(
    "CASE lvl WHEN 'critical' THEN least(99.0::double, 75 + (frp0 - 100) * 0.15::double) WHEN 'high' THEN 60 + (frp0 - 50) * 0.3::double WHEN 'medium' THEN 35 + (frp0 - 20) * 0.8::double ELSE greatest(5.0::double, frp0 * 1.5::double) END",
    1,
)
H = f"""{BASE}, h AS (SELECT 'EV-' || lpad(event_id::varchar, 9, '0') AS id, event_id, user_id, {LAT} AS latitude, {LON} AS longitude, bright AS brightness,
 strftime(ts, '%Y-%m-%d') AS acq_date, strftime(ts, '%H%M') AS acq_time, ts, 'Suomi-NPP' AS satellite, regexp_extract(props, '([0-9]+)', 1) AS confidence, frp0 AS frp,
 CASE event_type WHEN 'click' THEN 'wildfire' WHEN 'view' THEN 'industrial' WHEN 'purchase' THEN 'agricultural' WHEN 'signup' THEN 'urban' WHEN 'error' THEN 'volcanic' ELSE 'unknown' END AS source_type,
 CASE event_type WHEN 'click' THEN 'dense_coniferous_forest' WHEN 'view' THEN 'industrial_site' WHEN 'purchase' THEN 'cropland' WHEN 'signup' THEN 'urban_wildland_interface' WHEN 'error' THEN 'chaparral_scrubland' ELSE 'unknown' END AS land_cover,
 {SCORE} AS risk_score, lvl AS risk_level, CASE lvl WHEN 'critical' THEN true WHEN 'high' THEN frp0 >= 80 ELSE false END AS is_anomaly,
 CASE WHEN user_id % 10 = 0 THEN 'C' || user_id::varchar END AS cluster_id, 'Site ' || user_id::varchar || ', ' || ['CA','TX','OR','HI'][(user_id % 4 + 1)::int] AS nearest_place FROM scored)
"""
TIER = "CASE greatest(CASE risk_level WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END, CASE WHEN risk_score >= 75 THEN 3 WHEN risk_score >= 50 THEN 2 WHEN risk_score >= 25 THEN 1 ELSE 0 END) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"
FEATURES = """f AS (SELECT 'node/' || c_custkey::varchar AS fid, c_name AS fname,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'settlement' WHEN 'AUTOMOBILE' THEN 'infrastructure' WHEN 'MACHINERY' THEN 'industrial' WHEN 'HOUSEHOLD' THEN 'protected_area' WHEN 'FURNITURE' THEN 'natural' ELSE 'unknown' END AS category,
 30.0::double + (c_custkey % 50) * 0.05::double + 0.004::double AS flat, -120.0::double + (floor(c_custkey / 50) % 30) * 0.05::double + 0.003::double AS flon FROM customer)
"""
# A plain box around each point keeps the join small; it is wider than any radius asked for.
PAIRS = f"""{H}, {FEATURES}, p AS (SELECT h.id, f.fid, f.category, {meters("latitude", "longitude", "flat", "flon")} AS m FROM h JOIN f ON flat BETWEEN latitude - 0.1 AND latitude + 0.1 AND flon BETWEEN longitude - 0.2 AND longitude + 0.2)
"""
WEATHER = """w0 AS (SELECT 3000 + (s_suppkey % 50) * 5 + floor(s_suppkey / 50) % 3 - 1 AS glat, -12000 + (floor(s_suppkey / 50) % 30) * 5 AS glon, 10.0::double + s_suppkey % 30 AS temperature, (s_suppkey % 110)::double AS humidity,
 (s_suppkey % 60)::double AS wind, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 60 + 12)::double END AS gust, (s_suppkey * 37 % 720)::double AS direction, CASE WHEN s_suppkey % 4 = 0 THEN 1.5::double ELSE 0.0::double END AS rain FROM supplier)
"""
COMPASS = "['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][(floor(((direction % 360) + 11.25::double) / 22.5::double) % 16)::int + 1]"


def fwi(t: str, rh: str, w: str, g: str, r: str) -> str:
    blow = f"CASE WHEN {g} > {w} THEN 0.7::double * {w} + 0.3::double * {g} ELSE {w} END"
    dry = f"{clamp(f'({t} - 5) * 0.875::double', '0', '35')} + {clamp(f'(100 - {rh}) * 0.388::double', '0', '35')} + {clamp(f'({blow}) / 50 * 30', '0', '30')}"
    wet = f"CASE WHEN {r} > 0 THEN 1 - least(0.8::double, {r} * 0.15::double) ELSE 1.0::double END"
    return up(clamp(f"({dry}) * ({wet})", "0", "100"), 1)


E_ = "event_id"
SCORING = f"""{H}, s AS (SELECT * REPLACE (CASE WHEN {E_} % 60 <> 0 THEN land_cover END AS land_cover), CASE WHEN {E_} % 3 <> 0 THEN (({E_} * 13) % 4000)::double END AS d_ind, CASE WHEN {E_} % 3 <> 0 THEN {E_} % 5 END AS n_ind, CASE WHEN {E_} % 4 <> 0 THEN (({E_} * 29) % 12000)::double END AS d_set,
 CASE WHEN {E_} % 5 <> 0 THEN (({E_} * 17) % 6000)::double END AS d_inf, CASE WHEN {E_} % 6 <> 5 AND {E_} % 60 <> 0 THEN {E_} % 6 = 0 END AS prot, CASE WHEN {E_} % 7 <> 0 THEN ({E_} % 60)::double END AS slope, CASE WHEN {E_} % 8 <> 0 THEN ({E_} % 45)::double END AS temp,
 CASE WHEN {E_} % 8 <> 0 THEN (({E_} * 7) % 101)::double END AS rh, CASE WHEN {E_} % 8 <> 0 THEN (({E_} * 3) % 70)::double END AS wind, CASE WHEN {E_} % 8 <> 0 THEN ({E_} % 3)::double END AS rain, CASE WHEN {E_} % 9 = 1 THEN ({E_} % 100)::double END AS fwi,
 CASE WHEN {E_} % 10 <> 9 THEN {E_} % 25 END AS n30, CASE WHEN {E_} % 10 <> 9 THEN {E_} % 25 + {E_} % 13 END AS n90, CASE WHEN {E_} % 10 <> 9 THEN {E_} % 25 >= 20 END AS rec, CASE WHEN {E_} % 11 = 0 THEN ({E_} % 100) / 100.0::double END AS pers FROM h)
"""


def near(d: str, most: int, imm: int) -> str:
    return f"CASE WHEN {d} IS NULL OR {d} < 0 THEN 0.0::double WHEN {d} <= {imm} THEN 1.0::double WHEN {d} >= {most} THEN 0.0::double ELSE ({most} - {d}) / {most - imm}.0::double END"


CONF = "CASE WHEN try_cast(confidence AS double) > 1 THEN least(greatest(confidence::double / 100, 0.0::double), 1.0::double) WHEN try_cast(confidence AS double) IS NOT NULL THEN least(greatest(confidence::double, 0.0::double), 1.0::double) ELSE 0.65::double END"
WX = (
    "CASE WHEN fwi IS NOT NULL THEN least(greatest(fwi / 100, 0.0::double), 1.0::double) WHEN temp IS NULL AND rh IS NULL AND wind IS NULL THEN NULL ELSE least(greatest(("
    "0.45::double * CASE WHEN wind IS NULL THEN 0.2::double ELSE least(greatest(wind / 55, 0.0::double), 1.0::double) END + 0.40::double * CASE WHEN rh IS NULL THEN 0.5::double ELSE least(greatest((100 - rh) / 85, 0.0::double), 1.0::double) END + "
    "0.15::double * CASE WHEN temp IS NULL THEN 0.3::double ELSE least(greatest((temp - 12) / 28, 0.0::double), 1.0::double) END) * CASE WHEN rain > 0 THEN greatest(0.1::double, 1 - rain / 10) ELSE 1.0::double END, 0.0::double), 1.0::double) END"
)
VEG = "'forest|woodland|trees|chaparral|shrub|bush|grass|grassland|jungle|taiga|savanna|scrub'"
IND = "'industrial|refinery|factory|plant|manufacturing|chemical|smelter|foundry|stack|quarry|mine|power_plant'"
AGR = "'agri|crop|cropland|farmland|field|stubble|paddy|pasture'"
URB = "'urban|residential|commercial|city|town|building'"
X = f"""{SCORING}, x0 AS (SELECT *, {CONF} AS f_confidence, coalesce(regexp_matches(land_cover, {VEG}), false) AS is_vegetation, coalesce(regexp_matches(land_cover, {IND}), false) AS is_industrial, coalesce(regexp_matches(land_cover, {AGR}), false) AS is_agricultural, coalesce(regexp_matches(land_cover, {URB}), false) AS is_urban,
 (d_ind IS NOT NULL OR n_ind IS NOT NULL OR d_set IS NOT NULL OR d_inf IS NOT NULL OR prot IS NOT NULL OR land_cover IS NOT NULL) AS has_geo, (temp IS NOT NULL OR rh IS NOT NULL OR wind IS NOT NULL OR rain IS NOT NULL OR fwi IS NOT NULL) AS has_weather, (n30 IS NOT NULL OR n90 IS NOT NULL OR rec IS NOT NULL OR pers IS NOT NULL) AS has_history,
 coalesce(prot, false) AS protected, coalesce(rec, false) OR coalesce(n30 >= 10, false) AS recurrent,
 least(1.0::double, {near("d_ind", 3000, 800)} + CASE WHEN n_ind > 0 THEN least(0.3::double, n_ind * 0.1::double) ELSE 0.0::double END) AS ip FROM s),
x AS (SELECT *, {up(clamp("ln(1 + frp) / ln(251.0::double)", "0", "1"), 4)} AS frp_norm, {up(clamp("(brightness - 290) / 140", "0", "1"), 4)} AS brightness_norm, {up("CASE WHEN is_industrial THEN greatest(ip, 0.85::double) ELSE ip END", 4)} AS industrial_proximity,
 {up(near("d_set", 7500, 1500), 4)} AS settlement_proximity, {up(near("d_inf", 5000, 500), 4)} AS infrastructure_proximity, {up(clamp("coalesce(slope, 0.0::double) / 45", "0", "1"), 4)} AS slope_factor,
 {up("CASE WHEN pers IS NOT NULL THEN least(greatest(pers, 0.0::double), 1.0::double) WHEN n30 IS NOT NULL THEN least(greatest(n30 / 20.0::double, 0.0::double), 1.0::double) WHEN n90 IS NOT NULL THEN least(greatest(n90 / 45.0::double, 0.0::double), 1.0::double) ELSE 0.0::double END", 4)} AS persistence_score, {up(WX, 4)} AS weather_score FROM x0)
"""
P = "industrial_proximity"
C = f"""{X}, e AS (SELECT *, greatest(0.01::double, 0.1::double + CASE WHEN is_vegetation THEN CASE WHEN protected AND frp < 55 THEN 0.35::double ELSE 1.0::double + CASE WHEN frp >= 35 THEN 0.6::double ELSE 0.0 END + CASE WHEN weather_score >= 0.5 THEN 0.8::double * weather_score ELSE 0.0 END
   + CASE WHEN slope_factor > 0.3::double THEN 0.4::double * slope_factor ELSE 0.0 END + CASE WHEN {P} < 0.2::double THEN 0.5::double ELSE 0.0 END END WHEN NOT (is_industrial OR {P} >= 0.4::double) AND frp >= 60 THEN 0.9::double ELSE 0.0 END) AS e1,
 0.1::double + CASE WHEN ({P} >= 0.4::double OR is_industrial) AND frp >= 40 AND f_confidence >= 0.7::double THEN 1.2::double * {P} + 1.2::double + CASE WHEN persistence_score < 0.3::double THEN 0.6::double ELSE 0.0 END ELSE 0.0 END
   + CASE WHEN ({P} >= 0.4::double OR is_industrial) AND NOT (frp >= 40 AND f_confidence >= 0.7::double) AND frp >= 20 THEN 1.2::double * {P} + 0.4::double ELSE 0.0 END AS e2,
 0.1::double + CASE WHEN protected AND frp >= 3 AND frp < 55 THEN 1.8::double WHEN is_agricultural THEN 1.2::double WHEN {P} >= 0.7::double AND frp < 30 AND persistence_score >= 0.3::double THEN 0.7::double ELSE 0.0 END AS e3,
 0.1::double + CASE WHEN persistence_score >= 0.5::double OR coalesce(n30, 0) >= 10 THEN 1 + least(1.2::double, 1.5::double * persistence_score) + CASE WHEN {P} >= 0.5::double THEN 0.8::double ELSE 0.0 END ELSE 0.0 END AS e4,
 0.15::double + CASE WHEN f_confidence < 0.45::double THEN 0.8::double ELSE 0.0 END + CASE WHEN NOT has_geo AND NOT has_history AND NOT has_weather THEN 0.9::double ELSE 0.0 END + CASE WHEN frp < 8 AND NOT recurrent AND NOT protected THEN 0.4::double ELSE 0.0 END AS e5 FROM x),
q AS (SELECT *, {up("e1 / (e1 + e2 + e3 + e4 + e5)", 4)} AS p1, {up("e2 / (e1 + e2 + e3 + e4 + e5)", 4)} AS p2, {up("e3 / (e1 + e2 + e3 + e4 + e5)", 4)} AS p3, {up("e4 / (e1 + e2 + e3 + e4 + e5)", 4)} AS p4, {up("e5 / (e1 + e2 + e3 + e4 + e5)", 4)} AS p5 FROM e),
t AS (SELECT *, greatest(p1, p2, p3, p4, p5) AS top, list_reverse_sort([p1, p2, p3, p4, p5])[1] - list_reverse_sort([p1, p2, p3, p4, p5])[2] AS margin FROM q),
k AS (SELECT *, CASE WHEN p1 = top THEN 'vegetation_fire' WHEN p2 = top THEN 'potential_industrial_fire' WHEN p3 = top THEN 'controlled_heat_source' WHEN p4 = top THEN 'persistent_thermal_source' ELSE 'unknown' END AS class FROM t),
c AS (SELECT *, CASE WHEN class = 'vegetation_fire' THEN 'wildfire' WHEN class IN ('potential_industrial_fire', 'persistent_thermal_source') THEN 'industrial' WHEN class = 'controlled_heat_source' AND is_agricultural THEN 'agricultural' WHEN class = 'controlled_heat_source' THEN 'prescribed_burn' ELSE 'unknown' END AS source,
 {up("CASE WHEN class = 'unknown' THEN least(0.55::double, greatest(0.2::double, 0.6::double * top)) ELSE least(greatest((0.45::double * top + 0.30::double * (0.35::double + 0.25::double * has_geo::int + 0.20::double * has_weather::int + 0.20::double * has_history::int) + 0.25::double * (0.5::double * f_confidence + 0.5::double * frp_norm)) * (0.5::double + least(0.5::double, 1.5::double * margin)), 0.2::double), 0.99::double) END", 3)} AS class_confidence,
 (frp - 25.0::double) / 20.0::double AS z, coalesce(n30 >= 15, false) OR recurrent AS usual FROM k)
"""
A = f"""{C}, a AS (SELECT *, CASE WHEN usual THEN z >= 3 ELSE z >= 2 END AS is_outlier, {up("CASE WHEN usual AND z < 3 THEN least(greatest(0.10::double + 0.04::double * z, 0.05::double), 0.25::double) WHEN usual THEN least(greatest(0.5::double + 0.08::double * z, 0.65::double), 0.95::double) WHEN z >= 2 THEN least(greatest(0.5::double + 0.1::double * z, 0.65::double), 0.99::double) ELSE least(0.55::double, greatest(0.0::double, (z + 1) / 5)) END", 3)} AS outlier_score, {up("z", 2)} AS deviation FROM c)
"""
R = f"""{A}, r0 AS (SELECT *, 100 * frp_norm AS rf, coalesce(100 * weather_score, 25.0::double) AS rw, CASE WHEN has_geo THEN {clamp("100 * (0.7::double * greatest(settlement_proximity, infrastructure_proximity) + 0.2::double * least(settlement_proximity, infrastructure_proximity)) + CASE WHEN protected THEN 10.0::double ELSE 0.0 END + 15 * slope_factor", "0", "100")} ELSE 20.0::double END AS rp,
 CASE WHEN recurrent OR coalesce(n30, 0) >= 10 THEN 15.0::double WHEN coalesce(n30, 0) > 0 THEN least(80.0::double, 30 + 8.0::double * n30) ELSE 35.0::double END AS rh_, 100 * outlier_score AS ro, CASE WHEN has_weather THEN 0.25::double ELSE 0.0::double END AS ww, CASE WHEN has_history THEN 0.1::double ELSE 0.0::double END AS wh, CASE WHEN has_geo THEN 0.2::double ELSE 0.0::double END AS wp FROM a),
r1 AS (SELECT *, ((rf * 0.35::double + rw * ww + rp * wp + rh_ * wh + ro * 0.1::double) / (0.35::double + ww + wp + wh + 0.1::double) + 8 * (f_confidence - 0.65::double)) * CASE source WHEN 'prescribed_burn' THEN 0.75::double WHEN 'agricultural' THEN 0.85::double ELSE 1.0::double END AS raw FROM r0),
r AS (SELECT *, {up(clamp("raw", "0", "100"), 1)} AS risk FROM r1)
"""
FACTORS = f"""{R}, g AS (SELECT *, {level("risk")} AS level, CASE WHEN frp >= 100 THEN {{'w': 0.35::double, 'i': 'critical'}} WHEN frp >= 40 THEN {{'w': 0.30::double, 'i': CASE WHEN risk >= 50 THEN 'high' ELSE 'medium' END}} WHEN frp >= 15 THEN {{'w': 0.20::double, 'i': 'medium'}} ELSE {{'w': 0.15::double, 'i': 'low'}} END AS g1,
 CASE WHEN NOT has_weather THEN {{'w': 0.10::double, 'i': 'low'}} WHEN coalesce(wind, 0) >= 30 AND CASE WHEN coalesce(rh, 0) = 0 THEN 50 ELSE rh END <= 25 THEN {{'w': 0.25::double, 'i': 'critical'}} WHEN coalesce(wind, 0) >= 20 OR CASE WHEN coalesce(rh, 0) = 0 THEN 50 ELSE rh END <= 35 THEN {{'w': 0.20::double, 'i': 'high'}} ELSE {{'w': 0.15::double, 'i': 'low'}} END AS g2,
 CASE WHEN d_set <= 2500 THEN {{'w': 0.25::double, 'i': CASE WHEN d_set <= 1200 THEN 'critical' ELSE 'high' END}} WHEN d_inf <= 1000 THEN {{'w': 0.20::double, 'i': CASE WHEN d_inf <= 500 THEN 'high' ELSE 'medium' END}} WHEN d_set > 10000 THEN {{'w': 0.15::double, 'i': 'low'}} END AS g3,
 CASE WHEN is_outlier AND outlier_score >= 0.65::double THEN {{'w': 0.20::double, 'i': CASE WHEN outlier_score >= 0.8::double THEN 'high' ELSE 'medium' END}} WHEN recurrent OR coalesce(n30, 0) >= 10 THEN {{'w': 0.20::double, 'i': 'low'}} END AS g4 FROM r),
u AS (SELECT id, unnest([{{'n': 1, 'g': g1}}, {{'n': 2, 'g': g2}}, {{'n': 3, 'g': g3}}, {{'n': 4, 'g': g4}}]) AS o FROM g)
"""
ALERTS = f"""{H}, al AS (SELECT 'ALT-' || event_id::varchar AS id, 'H' || (event_id % 700)::varchar AS hotspot_id, CASE event_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, risk_score, (event_id * 7) % 5 = 0 AS is_acknowledged,
 acq_date || 'T' || acq_time[1:2] || ':' || acq_time[3:4] || ':00' AS timestamp, event_id AS seq FROM h),
li AS (SELECT hotspot_id, severity, list({{'id': id, 'risk': risk_score, 'ack': is_acknowledged, 'ts': timestamp, 'seq': seq}} ORDER BY seq) AS l FROM al GROUP BY ALL),
fo AS (SELECT hotspot_id, severity, list_reduce(l, lambda x, y: CASE WHEN x.ack AND NOT y.ack AND y.risk > x.risk THEN {{'id': y.id, 'risk': y.risk, 'ack': true, 'ts': y.ts, 'seq': y.seq}} WHEN NOT x.ack AND y.ack THEN y WHEN y.risk > x.risk THEN y ELSE x END) AS k FROM li),
de AS (SELECT k.id AS id, hotspot_id, severity, k.risk AS risk_score, k.ack AS is_acknowledged, k.ts AS timestamp, k.seq AS seq FROM fo)
"""
INC = "((h1.source_type = 'volcanic' AND h2.source_type IN ('agricultural', 'urban')) OR (h2.source_type = 'volcanic' AND h1.source_type IN ('agricultural', 'urban')) OR (h1.source_type = 'industrial' AND h2.source_type = 'wildfire') OR (h2.source_type = 'industrial' AND h1.source_type = 'wildfire'))"
M12 = meters("h1.latitude", "h1.longitude", "h2.latitude", "h2.longitude")
EDGES = f"""{H}, hh AS (SELECT *, strptime(acq_date || ' ' || acq_time, '%Y-%m-%d %H%M') AS at FROM h), pr AS (SELECT h1.id AS a, h2.id AS b, {M12} AS m, abs(epoch(h1.at) - epoch(h2.at)) / 3600.0 AS hrs, {INC} AS inc, coalesce(h1.cluster_id = h2.cluster_id, false) AS same
 FROM hh h1 JOIN hh h2 ON h2.latitude BETWEEN h1.latitude - 0.05 AND h1.latitude + 0.05 AND h2.longitude BETWEEN h1.longitude - 0.07 AND h1.longitude + 0.07 AND h1.id < h2.id),
ed AS (SELECT a, b FROM pr WHERE (m <= 1500 AND hrs <= 24 AND NOT (inc AND m > 300)) OR (same AND m <= 5000))
"""
N_RAW = "CASE WHEN event_id % 20 = 3 THEN 0.0::double WHEN event_id % 20 = 4 THEN 0.0::double ELSE greatest(value, 0.0::double) END"
RAW = f"""
r0 AS (SELECT *, event_id % 50 AS m50, {N_RAW} AS frp0, 300.0::double + value * 0.4::double AS bright, {LAT} AS latitude, {LON} AS longitude FROM events),
scored AS (SELECT *, CASE WHEN frp0 >= 100 OR bright >= 355 THEN 'critical' WHEN frp0 >= 50 OR bright >= 340 THEN 'high' WHEN frp0 >= 20 OR bright >= 325 THEN 'medium' ELSE 'low' END AS lvl,
 ['Suomi-NPP','NOAA-20','NOAA-21','Terra','Aqua','Suomi-NPP','Suomi-NPP','X9'][(event_id % 8 + 1)::int] AS satellite, strftime(ts, '%H%M') AS acq_time, regexp_extract(props, '([0-9]+)', 1)::double AS kk FROM r0),
n AS (SELECT event_id, latitude, longitude, bright AS brightness, strftime(ts, '%Y-%m-%d') AS acq_date, acq_time, satellite, CASE WHEN satellite IN ('Terra', 'Aqua') THEN 'MODIS' ELSE 'VIIRS' END AS instrument,
 CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'nominal' WHEN 3 THEN CASE WHEN kk >= 80 THEN 'high' WHEN kk >= 30 THEN 'nominal' ELSE 'low' END ELSE 'nominal' END AS confidence, frp0 AS frp,
 CASE event_id % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'N' ELSE CASE WHEN acq_time[1:2]::int BETWEEN 6 AND 18 THEN 'D' ELSE 'N' END END AS daynight, {SCORE} AS risk_score, lvl AS risk_level, CASE lvl WHEN 'critical' THEN true WHEN 'high' THEN frp0 >= 80 ELSE false END AS is_anomaly FROM scored WHERE m50 NOT IN (0, 1, 2))
"""
ORACLES: dict[str, str] = {
    "ingest_normalize": f"WITH {RAW} SELECT instrument || '-' || replace(upper(satellite), '-', '') || '-' || replace(acq_date, '-', '') || '-' || upper(md5(printf('%.4f_%.4f_%s', latitude, longitude, acq_time))[1:6]) AS id, * EXCLUDE (event_id) FROM n",
    "ingest_rejects": "SELECT CASE event_id % 50 WHEN 0 THEN 'out of range' ELSE 'missing' END AS rejected, count(*) AS n FROM events WHERE event_id % 50 IN (0, 1, 2) GROUP BY 1",
    "ingest_dedup": f"WITH {RAW} SELECT 'K' || (event_id % 4000)::varchar AS id, event_id, frp, satellite FROM n QUALIFY row_number() OVER (PARTITION BY event_id % 4000 ORDER BY event_id) = 1",
    "ingest_sequence": "SELECT event_id, 'VIIRS-NOAA20-' || strftime(ts, '%Y%m%d') || '-' || CASE WHEN row_number() OVER (ORDER BY event_id) < 10000 THEN lpad((row_number() OVER (ORDER BY event_id))::varchar, 4, '0') ELSE (row_number() OVER (ORDER BY event_id))::varchar END AS id FROM events",
    "upsert_merge": f"WITH {H}, b AS (SELECT id, frp, risk_level, -1 AS o FROM h WHERE event_id % 3 <> 0 UNION ALL SELECT 'EV-' || lpad((event_id - event_id % 4)::varchar, 9, '0'), frp, 'new', event_id FROM h WHERE event_id % 2 = 0) SELECT id, frp, risk_level FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY o DESC) = 1",
    "hotspots_page": f"WITH {H} SELECT id, frp, acq_date, acq_time FROM h WHERE risk_level = 'critical' AND source_type = 'wildfire' AND frp >= 50 ORDER BY frp DESC, acq_date DESC, acq_time DESC, id LIMIT 50 OFFSET 50",
    "region_search": f"WITH {H} SELECT 'california' AS region, id FROM h WHERE (contains(nearest_place, 'CA') OR (latitude BETWEEN 32 AND 42 AND longitude BETWEEN -125 AND -114)) AND (contains(lower(nearest_place), 'site 1') OR contains(lower(id), 'site 1') OR coalesce(contains(lower(cluster_id), 'site 1'), false)) UNION ALL SELECT 'pacific_nw', id FROM h WHERE (contains(nearest_place, 'OR') OR contains(nearest_place, 'WA')) AND is_anomaly",
    "kpi_summary": f"WITH {H}, z AS (SELECT *, {TIER} AS tier FROM h) SELECT count(*) AS total, count_if(tier = 'low')::bigint AS n_low, count_if(tier = 'medium')::bigint AS n_medium, count_if(tier = 'high')::bigint AS n_high, count_if(tier = 'critical')::bigint AS n_critical, count_if(is_anomaly)::bigint AS n_anomalies, {up('sum(floor(frp * 100 + 0.5)::bigint)::bigint / count(*) / 100.0::double', 2)} AS avg_frp, {up('max(frp)', 2)} AS max_frp, {up('sum(floor(risk_score * 10 + 0.5)::bigint)::bigint / count(*) / 10.0::double', 1)} AS avg_risk, (SELECT source_type FROM h GROUP BY 1 ORDER BY count(*) DESC, source_type DESC LIMIT 1) AS dominant_source FROM z",
    "source_breakdown": f"WITH {H}, l(source_type, label, driver) AS (VALUES ('wildfire', 'Wildfire / Forest Fire', 'Vegetative dry fuel & wind propagation'), ('industrial', 'Industrial Facility / Flare Stack', 'Petrochemical, refining, & gas processing'), ('agricultural', 'Agricultural Residue Burn', 'Seasonal crop clearing & stubble combustion'), ('urban', 'Urban Structural / Heat Anomaly', 'High thermal mass, roofing, or localized structural fire'), ('volcanic', 'Volcanic / Geothermal Activity', 'Magmatic effusion & geothermal vents')) SELECT source_type, count(*) AS n, {up('100.0::double * count(*) / sum(count(*)) OVER ()::double', 1)} AS pct, {up('sum(floor(frp * 100 + 0.5)::bigint)::bigint / count(*) / 100.0::double', 2)} AS avg_frp, {up('sum(floor(risk_score * 10 + 0.5)::bigint)::bigint / count(*) / 10.0::double', 1)} AS avg_risk, any_value(label) AS label, any_value(driver) AS driver FROM h JOIN l USING (source_type) GROUP BY source_type",
    "dominant_source": f"WITH {H} SELECT source_type, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, {up('sum(floor(risk_score * 10 + 0.5)::bigint)::bigint / count(*) / 10.0::double', 1)} DESC, source_type LIMIT 1",
    "risk_distribution": f"WITH {H} SELECT risk_level, count(*) AS n FROM h GROUP BY 1",
    "top_critical": f"WITH {H}, z AS (SELECT *, {TIER} AS tier FROM h) SELECT id, tier, risk_score, frp FROM z WHERE tier IN ('critical', 'high') ORDER BY risk_score DESC, frp DESC, id LIMIT 5",
    "haversine_pairs": f"WITH {FEATURES}, o AS (SELECT flat AS lat2, flon AS lon2 FROM f WHERE fid = 'node/1') SELECT fid AS id, {up(meters('flat', 'flon', 'lat2', 'lon2'), 1)} AS distance_m FROM f, o",
    "bbox_extent": f"WITH {H}, b AS (SELECT min(latitude) a, max(latitude) b, min(longitude) c, max(longitude) d FROM h) SELECT {up('greatest(a - 6.0::double / 111, -90.0::double)', 6)} AS south, {up('least(b + 6.0::double / 111, 90.0::double)', 6)} AS north, {up('greatest(c - 6.0::double / (111.0::double * greatest(0.01::double, abs(cos(radians((a + b) / 2))))), -180.0::double)', 6)} AS west, {up('least(d + 6.0::double / (111.0::double * greatest(0.01::double, abs(cos(radians((a + b) / 2))))), 180.0::double)', 6)} AS east FROM b",
    "compass": f"WITH {WEATHER} SELECT glat::bigint AS glat, glon::bigint AS glon, direction, {COMPASS} AS cardinal FROM w0",
    "fire_weather_index": f"WITH {WEATHER} SELECT glat::bigint AS glat, glon::bigint AS glon, temperature, wind, {fwi('temperature', 'humidity', 'wind', 'gust', 'rain')} AS fwi FROM w0",
    "nearest_feature": f"WITH {PAIRS} SELECT id, category, fid AS feature_id, {up('m', 1)} AS distance_m FROM p WHERE m <= 5000 QUALIFY row_number() OVER (PARTITION BY id, category ORDER BY {up('m', 3)}, fid) = 1",
    "radius_counts": f"WITH {PAIRS} SELECT h.id, count_if(category = 'industrial' AND m <= 5000)::bigint AS n_industrial, count_if(category = 'infrastructure' AND m <= 5000)::bigint AS n_infrastructure, count_if(category = 'settlement' AND m <= 10000)::bigint AS n_settlement FROM h LEFT JOIN p ON h.id = p.id GROUP BY h.id",
    "weather_grid_join": f"WITH {H}, {WEATHER}, w AS (SELECT DISTINCT ON (glat, glon) glat, glon, temperature, least(greatest(humidity, 0), 100)::double AS humidity, wind, gust, direction, rain FROM w0) SELECT id, temperature, humidity, CASE WHEN temperature IS NOT NULL THEN {fwi('temperature', 'humidity', 'wind', 'gust', 'rain')} END AS fwi, CASE WHEN temperature IS NOT NULL THEN {COMPASS} END AS cardinal, CASE WHEN temperature IS NULL THEN 'unavailable' ELSE 'available' END AS weather_status FROM h LEFT JOIN w ON floor(latitude * 100 + 0.5) = glat AND floor(longitude * 100 + 0.5) = glon",
    "recurrence": f"""WITH {H}, d AS (SELECT id, user_id, latitude, longitude, frp, acq_date::date AS day FROM h), j AS (SELECT h1.id, h1.day - h2.day AS age, h2.day AS rday, floor(h2.frp * 100 + 0.5)::bigint AS cents FROM d h1 JOIN d h2 ON h2.latitude BETWEEN h1.latitude - 0.01 AND h1.latitude + 0.01 AND h2.longitude BETWEEN h1.longitude - 0.013 AND h1.longitude + 0.013 AND h1.id <> h2.id AND h2.day <= h1.day AND {M12} <= 1000),
 g AS (SELECT id, count_if(age <= 7)::bigint AS n30, count_if(age <= 30)::bigint AS n90, count(DISTINCT CASE WHEN age <= 7 THEN rday END) AS days, min(rday) AS f, max(rday) AS l, sum(CASE WHEN age <= 7 THEN cents END)::bigint / count_if(age <= 7) / 100.0::double AS mean FROM j GROUP BY id),
 o AS (SELECT d.id, d.frp, coalesce(n30, 0) AS n30, coalesce(n90, 0) AS n90, coalesce(days, 0) AS days, f, l, coalesce(mean, 0.0) AS mean FROM d LEFT JOIN g USING (id))
 SELECT id, n30 AS prior_30d, n90 AS prior_90d, n30 >= 3 OR n90 >= 6 AS is_recurrent, n30 >= 1 AS is_repeated, least(1.0::double, {up('n30 * 0.05::double + greatest(n90 - n30, 0) * 0.015::double', 2)}) AS frequency, least(1.0::double, {up('days / 7.0::double', 2)}) AS persistence, strftime(f, '%Y-%m-%d') AS first_date,
 CASE WHEN n30 >= 8 AND mean < 45 THEN 'known_industrial_stack' WHEN n30 >= 3 AND l - f <= 5 AND (mean >= 45 OR frp >= 50) THEN 'persistent_burn' WHEN n30 >= 3 AND mean BETWEEN 10 AND 60 THEN 'agricultural_clearing' WHEN n30 >= 2 THEN 'persistent_burn' ELSE 'none' END AS pattern FROM o""",
    "osm_categorise": """WITH k AS (SELECT c_custkey AS k, c_custkey % 12 AS r FROM customer), e AS (SELECT k, r, 'node' AS t, (k % 200 - 100)::double AS latitude, (k % 300 - 150)::double AS longitude FROM k UNION ALL SELECT k, r, 'way', CASE WHEN k % 2 = 0 THEN (k % 80)::double ELSE (k % 80 + k % 80 + 1) / 2.0::double END, CASE WHEN k % 2 = 0 THEN (k % 170)::double ELSE (k % 170 + k % 170 + 3) / 2.0::double END FROM k)
 SELECT t || '/' || k::varchar AS id, ['Plant','Industrial Works','Industrial (oil)','Power Generation Plant (gas)','Power Substation','A1 (Road)','Pipeline (gas)','Ville','Protected Conservation Area','Nature Reserve','Forest / Woodland Parcel','Geographic Feature'][(r + 1)::int] AS name,
 ['industrial','industrial','industrial','industrial','infrastructure','infrastructure','infrastructure','settlement','protected_area','protected_area','natural','other'][(r + 1)::int] AS category, ['industrial_complex','refinery','oil','power_gas','power_substation','highway_primary','pipeline','town','protected_area','nature_reserve','forest','unknown'][(r + 1)::int] AS feature_type, latitude, longitude FROM e WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180""",
    "geo_context": f"""WITH {PAIRS}, q AS (SELECT *, CASE WHEN category IN ('protected_area', 'natural') THEN 'protected' ELSE category END AS kind FROM p WHERE m <= 10000),
 g AS (SELECT id, min(CASE WHEN kind = 'industrial' THEN {{'d': {up('m', 3)}, 'f': fid, 'm': m}} END) AS i, min(CASE WHEN kind = 'settlement' THEN {{'d': {up('m', 3)}, 'f': fid, 'm': m}} END) AS s, min(CASE WHEN kind = 'protected' AND m <= 3000 THEN {{'d': {up('m', 3)}, 'f': fid, 'm': m}} END) AS pr, count_if(kind = 'industrial' AND m <= 5000)::bigint AS ni, count_if(kind = 'settlement')::bigint AS ns FROM q GROUP BY id)
 SELECT h.id, i.f AS nearest_industrial, {up('i.m', 1)} AS distance_industrial_m, pr.f AS nearest_protected, coalesce(ni, 0) AS nearby_industrial, coalesce(ns, 0) AS nearby_settlement, coalesce(pr.m <= 1500, false) AS is_protected,
 CASE WHEN i.m <= 400 THEN 'industrial_site' WHEN pr.m <= 1000 THEN 'dense_coniferous_forest' WHEN s.m <= 1000 THEN 'urban_wildland_interface' ELSE 'chaparral_scrubland' END AS land_cover, CASE WHEN i.m <= 400 THEN 'non_vegetated' WHEN pr.m <= 1000 THEN 'extreme_dry_chaparral' WHEN s.m <= 1000 THEN 'moderate_mixed' ELSE 'moderate' END AS fuel_load FROM h LEFT JOIN g USING (id)""",
    "enrich_status": f"WITH {H} SELECT id, CASE (event_id % 2 = 0)::int + (event_id % 3 = 0)::int + (event_id % 5 = 0)::int WHEN 3 THEN 'complete' WHEN 0 THEN 'unavailable' ELSE 'partial' END AS status FROM h",
    "feature_vector": f"WITH {X} SELECT id, frp_norm, brightness_norm, f_confidence, industrial_proximity, settlement_proximity, infrastructure_proximity, slope_factor, persistence_score, weather_score, is_vegetation, is_industrial, is_agricultural, is_urban, has_geo, has_weather, has_history, protected, recurrent FROM x",
    "classify": f"WITH {C} SELECT id, p1 AS p_vegetation_fire, p2 AS p_potential_industrial_fire, p3 AS p_controlled_heat_source, p4 AS p_persistent_thermal_source, p5 AS p_unknown, class, source, class_confidence FROM c",
    "anomaly_zscore": f"WITH {A} SELECT id, is_outlier, outlier_score, deviation FROM a",
    "anomaly_population_stats": f"WITH {H} SELECT {up('avg(frp)', 4)} AS mean, {up('greatest(stddev_pop(frp), 1.0::double)', 4)} AS std, count(*) AS n FROM h",
    "risk_score": f"WITH {R} SELECT id, {up('rf', 1)} AS risk_frp, {up('rw', 1)} AS risk_weather, {up('rp', 1)} AS risk_place, {up('rh_', 1)} AS risk_past, {up('ro', 1)} AS risk_odd, risk, {level('risk')} AS level FROM r",
    "risk_factors": f"WITH {FACTORS} SELECT id, count(*)::bigint AS n_factors, first(o.g.w ORDER BY o.g.w DESC, o.n) AS top_weight, first(o.g.i ORDER BY o.g.w DESC, o.n) AS top_impact, string_agg(o.g.i, ',' ORDER BY o.g.w DESC, o.n) AS impacts FROM u WHERE o.g IS NOT NULL GROUP BY id",
    "alerts_generate": f"WITH {SCORING} SELECT 'ALT-' || id AS id, id AS hotspot_id, CASE WHEN risk_level = 'critical' OR risk_score >= 75 THEN 'critical' ELSE 'warning' END AS severity, {up('risk_score', 1)} AS risk_score, acq_date || 'T' || acq_time[1:2] || ':' || acq_time[3:4] || ':00Z' AS timestamp, source_type || CASE WHEN prot THEN ',protected_area' ELSE '' END || CASE WHEN frp >= 100 THEN ',critical_frp' ELSE '' END || CASE WHEN is_anomaly THEN ',statistical_anomaly' ELSE '' END || CASE WHEN d_set > 0 AND d_set <= 2000 THEN ',settlement_proximity' ELSE '' END || CASE WHEN wind >= 30 THEN ',high_wind' ELSE '' END AS tags FROM s WHERE risk_level IN ('critical', 'high') OR risk_score >= 50",
    "alerts_dedup": f"WITH {ALERTS} SELECT * FROM de",
    "alerts_feed": f"WITH {ALERTS} SELECT id, severity, risk_score, timestamp FROM de WHERE NOT is_acknowledged ORDER BY CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END DESC, risk_score DESC, timestamp DESC, id LIMIT 50",
    "alerts_unread": f"WITH {ALERTS} SELECT count_if(NOT is_acknowledged)::bigint AS unread FROM de",
    "incident_edges": f"WITH {EDGES} SELECT * FROM ed",
    "incident_summary": f"""WITH {H}, hs AS (SELECT *, strptime(acq_date || ' ' || acq_time, '%Y-%m-%d %H%M') AS seen FROM h), p AS (SELECT user_id, id, source_type, risk_level, risk_score FROM hs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY risk_score DESC, frp DESC, seen DESC, id) = 1),
 sc AS (SELECT user_id, source_type, count(*) AS k, max(risk_score) AS mr FROM hs GROUP BY ALL), so AS (SELECT sc.user_id, sc.source_type FROM sc JOIN p USING (user_id) QUALIFY row_number() OVER (PARTITION BY sc.user_id ORDER BY k DESC, (sc.source_type = p.source_type) DESC, mr DESC, sc.source_type DESC) = 1)
 SELECT 'INC-' || any_value(p.id) AS incident_id, any_value(p.id) AS primary_id, count(*) AS n, any_value(p.risk_score) AS risk_score, any_value(p.risk_level) AS risk_level, {up('max(frp)', 2)} AS peak_frp, {up('sum(floor(frp * 100 + 0.5)::bigint)::bigint / count(*) / 100.0::double', 2)} AS avg_frp, bool_or(is_anomaly) AS is_anomaly, any_value(so.source_type) AS source_type,
 {up('sum(floor(latitude * 1000000.0::double + 0.5)::bigint)::bigint / count(*) / 1000000.0::double', 4)} AS latitude, {up('sum(floor(longitude * 1000000.0::double + 0.5)::bigint)::bigint / count(*) / 1000000.0::double', 4)} AS longitude, strftime(min(seen), '%Y-%m-%dT%H:%M:%SZ') AS first_seen, strftime(max(seen), '%Y-%m-%dT%H:%M:%SZ') AS last_seen,
 CASE WHEN any_value(p.risk_level) IN ('critical', 'high') OR (any_value(p.risk_level) = 'medium' AND bool_or(is_anomaly)) THEN 'active' ELSE 'monitoring' END AS status FROM hs JOIN p USING (user_id) JOIN so USING (user_id) GROUP BY hs.user_id""",
    "dossiers": f"""WITH {SCORING}, y AS (SELECT *, event_id % 3 = 0 AND event_id % 60 <> 0 AS gk, event_id % 3 = 0 AND event_id % 8 <> 0 AS wk, event_id % 3 = 0 AND event_id % 10 <> 9 AS hk FROM s) SELECT id, CASE WHEN gk THEN land_cover ELSE 'unclassified_terrain' END AS land_cover, CASE WHEN gk THEN NULL ELSE 'moderate' END AS fuel_load, CASE WHEN wk THEN temp ELSE 24.0::double END AS temperature, CASE WHEN wk THEN rh ELSE 35.0::double END AS humidity, CASE WHEN wk THEN NULL ELSE 'S' END AS cardinal,
 (CASE WHEN hk THEN n30 ELSE 0 END)::bigint AS prior_30d, CASE WHEN hk THEN NULL ELSE 'none' END AS pattern, acq_date AS first_date, gk AS geospatial_known, wk AS weather_known, hk AS historical_known FROM y""",
    "kv_meta": "SELECT 'k' || (event_id % 20)::varchar AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY 1",
    "cache_fresh_stale": "WITH e AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'osm' ELSE 'weather' END AS namespace, event_id % 300 AS key, max(ts) AS created FROM events WHERE event_id % 11 <> 0 GROUP BY ALL) SELECT namespace, floor(epoch(TIMESTAMP '2024-01-30 12:00:00')) - floor(epoch(created)) <= CASE namespace WHEN 'osm' THEN 86400 ELSE 3600 END AS is_fresh, count(*) AS n FROM e GROUP BY ALL",
    "cache_keys": f"WITH {FEATURES} SELECT fid AS id, sha256('osm_' || printf('%.4f', flat) || '_' || printf('%.4f', flon))[1:32] AS cache_key FROM f",
    "stream_window_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, sum(floor(value * 100 + 0.5)::bigint)::bigint AS cents FROM events GROUP BY ALL",
    "display_format": f"WITH {H} SELECT id, printf('%.4f%s, %.4f%s', abs(latitude), CASE WHEN latitude >= 0 THEN 'N' ELSE 'S' END, abs(longitude), CASE WHEN longitude >= 0 THEN 'E' ELSE 'W' END) AS place, upper(source_type[1]) || source_type[2:] AS source, split_part(nearest_place, ',', 1) AS site, least(greatest(floor(frp * 45)::bigint, 1200), 8000)::bigint AS halo_m FROM h",
}
ORACLES["incident_components"] = f"""WITH RECURSIVE {EDGES}, sy AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed), reach(id, c) AS (SELECT a, a FROM sy UNION SELECT sy.b, reach.c FROM reach JOIN sy ON reach.id = sy.a WHERE reach.c < sy.b) SELECT DISTINCT s.a AS id, least(s.a, coalesce((SELECT min(c) FROM reach WHERE reach.id = s.a), s.a)) AS component FROM sy s"""
ORACLES["alert_acknowledge"] = ORACLES["alert_acknowledge_all"] = f"WITH {ALERTS} SELECT id, is_acknowledged OR id = 'ALT-17' AS is_acknowledged FROM al"
ORACLES["recurrence_7_30"] = ORACLES["recurrence"]
ORACLES["recurrence"] = ORACLES["recurrence_90d"] = ORACLES["recurrence_7_30"].replace("age <= 30", "age <= 90").replace("age <= 7", "age <= 30")
# Incidents: each detection belongs to the first one, in the order of gravity, from which edges lead down to it.
CLUSTERS = f"""{EDGES}, rk AS (SELECT *, row_number() OVER (ORDER BY risk_score DESC, frp DESC, id) AS k FROM hh),
down AS (SELECT least(x.k, y.k) AS above, greatest(x.k, y.k) AS below FROM ed JOIN rk x ON x.id = ed.a JOIN rk y ON y.id = ed.b),
reach(k, top) AS (SELECT k, k FROM rk WHERE k NOT IN (SELECT below FROM down) UNION SELECT down.below, reach.top FROM reach JOIN down ON down.above = reach.k),
cl AS (SELECT k, min(top) AS top FROM reach GROUP BY k)
"""
ORACLES["incident_clusters"] = f"WITH RECURSIVE {CLUSTERS} SELECT x.id, y.id AS seed FROM cl JOIN rk x ON x.k = cl.k JOIN rk y ON y.k = cl.top"
ORACLES["incident_alerts"] = f"""WITH RECURSIVE {CLUSTERS}, pri AS (SELECT rk.* FROM cl JOIN rk USING (k) QUALIFY row_number() OVER (PARTITION BY top ORDER BY risk_score DESC, frp DESC, rk."at" DESC, ascii(id), id) = 1)
SELECT 'ALT-' || id AS id, id AS hotspot_id, CASE WHEN risk_level = 'critical' OR risk_score >= 75 THEN 'critical' ELSE 'warning' END AS severity, {up('risk_score', 1)} AS risk_score FROM pri WHERE risk_level IN ('critical', 'high') OR risk_score >= 50"""

# The isolation forest: samples by digest, trees grown level by level, then walked level by level. x is the table of features.
def draw(what: str) -> str:
    return f"('0x' || substr(md5('42:' || t::varchar || ':' || path || ':{what}'), 1, 8))::bigint / 4294967296.0::double"


def forest_sql(features: str) -> str:
    usual = lambda n: f"CASE WHEN {n} < 2 THEN 0.0::double WHEN {n} < 3 THEN 1.0::double ELSE 2 * (ln({n} - 1) + 0.5772156649::double) - 2 * ({n} - 1) / {n}::double END"
    return f"""{features}, pop AS (SELECT id, frp AS v0, CASE WHEN coalesce(brightness, 0) = 0 THEN 310.0::double ELSE brightness END AS v1, persistence_score AS v2, md5('42:' || id) AS d FROM x),
sam AS (SELECT t, v0, v1, v2 FROM (SELECT *, unnest(range(50)) AS t FROM pop) QUALIFY row_number() OVER (PARTITION BY t ORDER BY (('0x' || substr(d, 1, 8))::bigint % 2147483647 + ('0x' || substr(d, 9, 8))::bigint % 2147483647 * (t + 1)) % 2147483647, id, v0, v1, v2) <= 256),
lim AS (SELECT least(count(*), 256) AS n, ceil(log2(greatest(2, least(count(*), 256))))::bigint AS depth FROM pop),
lev AS (
  SELECT t, '' AS path, v0, v1, v2 FROM sam
  UNION ALL
  SELECT t, path || CASE WHEN [v0, v1, v2][f] < lo[f] + u * (hi[f] - lo[f]) THEN 'L' ELSE 'R' END, v0, v1, v2
  FROM (SELECT *, can[floor({draw('feature')} * len(can))::bigint + 1] AS f, {draw('cut')} AS u FROM (SELECT *, list_filter([1, 2, 3], lambda k: hi[k] > lo[k]) AS can FROM
    (SELECT *, count(*) OVER w AS n, [min(v0) OVER w, min(v1) OVER w, min(v2) OVER w] AS lo, [max(v0) OVER w, max(v1) OVER w, max(v2) OVER w] AS hi FROM lev WINDOW w AS (PARTITION BY t, path))) WHERE n >= 2 AND len(can) > 0 AND len(path) < (SELECT depth FROM lim))),
grp AS (SELECT *, list_filter([1, 2, 3], lambda k: hi[k] > lo[k]) AS can FROM (SELECT t, path, count(*) AS n, [min(v0), min(v1), min(v2)] AS lo, [max(v0), max(v1), max(v2)] AS hi FROM lev GROUP BY t, path)),
nod AS (SELECT t, path, n, CASE WHEN inner_ THEN can[floor({draw('feature')} * len(can))::bigint + 1] END AS f, {draw('cut')} AS u, lo, hi, CASE WHEN NOT inner_ THEN len(path) * 1000000 + floor(({usual('n')}) * 1000000 + 0.5)::bigint END AS leaf FROM (SELECT *, n >= 2 AND len(can) > 0 AND len(path) < (SELECT depth FROM lim) AS inner_ FROM grp)),
wlk AS (
  SELECT id, v0, v1, v2, t, '' AS path, NULL::bigint AS leaf FROM pop, range(50) AS r(t)
  UNION ALL
  SELECT w.id, v0, v1, v2, w.t, w.path || CASE WHEN [v0, v1, v2][f] < lo[f] + u * (hi[f] - lo[f]) THEN 'L' ELSE 'R' END, NULL FROM wlk w JOIN nod ON nod.t = w.t AND nod.path = w.path AND nod.leaf IS NULL),
sco AS (SELECT w.id, any_value(v0) AS frp0, pow(2.0::double, -(sum(nod.leaf)::bigint / (50 * 1000000.0::double)) / greatest(1e-9::double, (SELECT {usual('n')} FROM lim))) AS score FROM wlk w JOIN nod ON nod.t = w.t AND nod.path = w.path AND nod.leaf IS NOT NULL GROUP BY w.id),
thr AS (SELECT quantile_cont(score, 0.9) AS cut, avg(frp0) AS m, greatest(stddev_pop(frp0), 1.0::double) AS sd FROM sco),
fo AS (SELECT id AS oid, cut - score < 0 OR 1 / (1 + exp(6 * (cut - score))) >= 0.65::double OR (frp0 - m) / sd >= 2 AS o_odd, {up('1 / (1 + exp(6 * (cut - score)))', 3)} AS o_score, {up('(frp0 - m) / sd', 2)} AS o_dev FROM sco, thr)
"""


ORACLES["forest_nodes"] = f"WITH RECURSIVE {forest_sql(X)} SELECT t AS tree, path, n AS size, f - 1 AS feature, CASE WHEN f IS NOT NULL THEN lo[f] + u * (hi[f] - lo[f]) END AS cut, leaf AS depth FROM nod"
ORACLES["anomaly_forest"] = f"WITH RECURSIVE {forest_sql(X)} SELECT oid AS id, o_odd AS is_outlier, o_score AS outlier_score, o_dev AS deviation FROM fo"
BATCH = R.replace(A, forest_sql(C) + ", a AS (SELECT *, o_odd AS is_outlier, o_score AS outlier_score, o_dev AS deviation FROM c JOIN fo ON oid = id)\n")
ORACLES["batch_analyze"] = f"""WITH RECURSIVE {BATCH} SELECT id, source, is_outlier, outlier_score, deviation, risk, {level("risk")} AS level,
 CASE WHEN is_outlier THEN printf('Stands out from the population: score %.3f, %.2f deviations.', outlier_score, deviation) ELSE printf('In line with the population: score %.3f.', outlier_score) END AS rationale FROM r"""

# The chain from end to end: all three contexts by joins, then the scoring of `s`.
ENRICHED = f"""{PAIRS}, {WEATHER},
gq AS (SELECT *, CASE WHEN category IN ('protected_area', 'natural') THEN 'protected' ELSE category END AS kind FROM p WHERE m <= 10000),
gg AS (SELECT id, min(m) FILTER (kind = 'industrial') AS mi, min(m) FILTER (kind = 'infrastructure') AS mf, min(m) FILTER (kind = 'settlement') AS ms, min(m) FILTER (kind = 'protected' AND m <= 3000) AS mp, count_if(kind = 'industrial' AND m <= 5000)::bigint AS ni FROM gq GROUP BY id),
ww AS (SELECT glat, glon, max({{'temp': temperature, 'rh': humidity, 'wind': wind, 'gust': gust, 'direction': direction, 'rain': rain}}) AS v FROM w0 GROUP BY glat, glon),
w AS (SELECT glat, glon, v.temp AS temperature, least(greatest(v.rh, 0), 100)::double AS humidity, greatest(v.wind, 0)::double AS wind, v.gust AS gust, greatest(v.rain, 0)::double AS rain FROM ww),
d AS (SELECT id, latitude, longitude, acq_date::date AS day FROM h),
j AS (SELECT h1.id, h1.day - h2.day AS age, h2.day AS rday FROM d h1 JOIN d h2 ON h2.latitude BETWEEN h1.latitude - 0.01 AND h1.latitude + 0.01 AND h2.longitude BETWEEN h1.longitude - 0.013 AND h1.longitude + 0.013 AND h1.id <> h2.id AND h2.day <= h1.day AND {M12} <= 1000),
hi AS (SELECT id, count_if(age <= 30)::bigint AS a, count_if(age <= 90)::bigint AS b, count(DISTINCT CASE WHEN age <= 30 THEN rday END) AS days FROM j GROUP BY id),
s AS (SELECT h.* REPLACE (CASE WHEN mi <= 400 THEN 'industrial_site' WHEN mp <= 1000 THEN 'dense_coniferous_forest' WHEN ms <= 1000 THEN 'urban_wildland_interface' ELSE 'chaparral_scrubland' END AS land_cover),
  {up('mi', 1)} AS d_ind, coalesce(ni, 0) AS n_ind, {up('ms', 1)} AS d_set, {up('mf', 1)} AS d_inf, coalesce(mp <= 1500, false) AS prot, NULL::double AS slope, temperature AS temp, humidity AS rh, wind, rain, CASE WHEN temperature IS NOT NULL THEN {fwi('temperature', 'humidity', 'wind', 'gust', 'rain')} END AS fwi,
  coalesce(hi.a, 0) AS n30, coalesce(hi.b, 0) AS n90, coalesce(hi.a, 0) >= 3 OR coalesce(hi.b, 0) >= 6 AS rec, least(1.0::double, {up('coalesce(days, 0) / 7.0::double', 2)}) AS pers
 FROM h LEFT JOIN gg ON gg.id = h.id LEFT JOIN w ON floor(h.latitude * 100 + 0.5) = glat AND floor(h.longitude * 100 + 0.5) = glon LEFT JOIN hi ON hi.id = h.id)
"""
ADVICE = """CASE WHEN level = 'critical' AND source = 'wildfire' THEN 'Critical: send air and ground crews now and prepare evacuation within 5 km.' WHEN level = 'critical' AND source = 'industrial' THEN 'Critical: call hazardous-materials response and the site''s emergency manager.'
 WHEN level = 'critical' THEN 'Critical: send a field team to verify the source and secure the perimeter.' WHEN level = 'high' AND source = 'wildfire' THEN 'High: inform the regional duty officer, task the next overpass, ready suppression.' WHEN level = 'high' AND source = 'industrial' THEN 'High: compare with the site''s permits and ask the plant for its status.'
 WHEN level = 'high' THEN 'High: plan a surveillance flight and check local sensors.' WHEN level = 'medium' THEN 'Routine: keep tracking; look up burn permits of the district.' ELSE 'Log only: consistent with normal operations.' END"""
ORACLES["analyzed_end_to_end"] = f"""WITH {R.replace(SCORING, ENRICHED)}, z AS (SELECT *, {level("risk")} AS level FROM r)
SELECT id, CASE WHEN temp IS NULL THEN 'partial' ELSE 'complete' END AS enrichment, source, class_confidence, is_outlier, risk, level, {ADVICE} AS recommendation FROM z"""
ORACLES["stream_sessions"] = """WITH e AS (SELECT user_id, ts, value, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL AS new FROM events),
n AS (SELECT *, sum(new::int) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
g AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS b, count(*) AS n, sum(floor(value * 100 + 0.5)::bigint)::bigint AS cents FROM n GROUP BY user_id, k)
SELECT strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(b, '%Y-%m-%d %H:%M:%S') AS session_end, user_id, n, cents FROM g WHERE b <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY FROM events)"""
ORACLES["stream_first_seen"] = "SELECT DISTINCT 'S' || user_id::varchar AS id FROM events"
ORACLES["stream_alerts"] = f"WITH {ALERTS.replace('ORDER BY seq', 'ORDER BY timestamp, seq')} SELECT hotspot_id, severity, id, risk_score, is_acknowledged, seq FROM de"

SERIES = """p AS (SELECT s_suppkey AS k, unnest(range(s_suppkey % 24 + 1)) AS h FROM supplier WHERE s_suppkey % 17 <> 0)"""
ORACLES["weather_hourly"] = f"""WITH {SERIES} SELECT k AS site, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(h), '%Y-%m-%d %H:%M') AS at, CASE WHEN (h + k) % 5 <> 0 THEN (h + k % 30)::double END AS temperature, least(greatest((h * 7 + k) % 130 - 10, 0), 100)::double AS humidity,
 CASE WHEN h < 8 AND (h + k) % 7 <> 0 THEN greatest((h + k) % 40 - 2, 0)::double END AS wind, CASE WHEN k % 3 <> 0 THEN (h * 50 % 720 % 360)::double END AS direction FROM p WHERE h % 13 <> 12"""
ORACLES["weather_current"] = "SELECT s_suppkey AS site, (s_suppkey % 40)::double AS temperature, CASE WHEN s_suppkey % 5 <> 0 THEN least(s_suppkey % 120, 100) ELSE 50 END::double AS humidity, greatest(s_suppkey % 33 - 3, 0)::double AS wind, (s_suppkey * 37 % 720 % 360)::double AS direction, 0.0::double AS rain FROM supplier WHERE s_suppkey % 17 <> 0 AND s_suppkey % 4 <> 0"
ORACLES["zip_contexts"] = f"WITH {FEATURES}, l AS (SELECT s_suppkey AS site, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier), r AS (SELECT fid, category, row_number() OVER (ORDER BY fid) AS n FROM f) SELECT coalesce(l.n, r.n) AS sequence, site, fid AS feature, category FROM l FULL JOIN r ON l.n = r.n"
ORACLES["source_counts"] = f"WITH {H} SELECT source_type, count(*) AS n FROM h GROUP BY 1"
ORACLES["feeds"] = " UNION ALL ".join(f"(WITH {H} SELECT '{by}' AS feed, id FROM h WHERE risk_level = 'high' AND source_type = 'industrial' ORDER BY {order}, id LIMIT 40)" for by, order in (("risk", "risk_score DESC"), ("frp", "frp DESC"), ("time", "acq_date DESC, acq_time DESC")))
# `incident_summary` with the clusters in place of the sites
SUMMARY_TAIL = ORACLES["incident_summary"].split("SELECT user_id, id, source_type", 1)[1].replace("hs", "cs").replace("user_id", "top")
ORACLES["incident_table"] = f'''WITH RECURSIVE {CLUSTERS}, cs AS (SELECT rk.* EXCLUDE (user_id, "at"), "at" AS seen, top FROM rk JOIN cl USING (k)), p AS (SELECT top, id, source_type{SUMMARY_TAIL}'''
ORACLES["incident_feed"] = f"""WITH RECURSIVE {CLUSTERS}, pri AS (SELECT rk.*, max(rk."at") OVER (PARTITION BY top) AS last_at, top FROM cl JOIN rk USING (k) QUALIFY row_number() OVER (PARTITION BY top ORDER BY risk_score DESC, frp DESC, rk."at" DESC, ascii(id), id) = 1)
SELECT 'ALT-' || id AS id, id AS hotspot_id, CASE WHEN risk_level = 'critical' OR risk_score >= 75 THEN 'critical' ELSE 'warning' END AS severity, {up('risk_score', 1)} AS risk_score, strftime(last_at, '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM pri WHERE risk_level IN ('critical', 'high') OR risk_score >= 50"""
ORACLES["alert_order"] = f"""WITH {ALERTS}, pr AS (SELECT *, {{'s': CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END, 'r': risk_score, 't': timestamp, 'id': id}} AS p FROM al), mx AS (SELECT hotspot_id, max(p) AS m FROM pr GROUP BY 1)
SELECT id, CASE WHEN p > m THEN 1 WHEN p < m THEN -1 ELSE 0 END::bigint AS "order" FROM pr JOIN mx USING (hotspot_id)"""
ORACLES["area_request"] = f"WITH {H} SELECT id, latitude, longitude, acq_date FROM h WHERE latitude BETWEEN 30.5 AND 31.5 AND longitude BETWEEN -119.99 AND -119.85 AND acq_date >= '2024-01-10'"
ORACLES["region_features"] = f"WITH {H}, {FEATURES}, b AS (SELECT min(latitude) a, max(latitude) b, min(longitude) c, max(longitude) d FROM h), w AS (SELECT a, b, c, d, 6.0::double / 111 AS y, 6.0::double / (111.0::double * greatest(0.01::double, abs(cos(radians((a + b) / 2))))) AS x FROM b) SELECT fid AS id, category FROM f, w WHERE flat BETWEEN a - y AND b + y AND flon BETWEEN c - x AND d + x"
ORACLES["class_margin"] = f"WITH {C} SELECT id, {up('margin', 4)} AS margin, frp_norm AS v0, brightness_norm AS v1, f_confidence AS v2, industrial_proximity AS v3, settlement_proximity AS v4, coalesce(weather_score, 0.35::double) AS v5, persistence_score AS v6, slope_factor AS v7 FROM c"
ORACLES["source_probabilities"] = f"""WITH {C}, sp AS (SELECT id, class, has_weather, [{{'n': 'wildfire', 'x': 0.9::double * p1 + 0.1::double * p3}}, {{'n': 'industrial', 'x': 0.85::double * p2 + 0.85::double * p4}}, {{'n': 'agricultural', 'x': p3 * CASE WHEN is_agricultural THEN 0.65::double ELSE 0.2::double END}},
 {{'n': 'prescribed_burn', 'x': p3 * CASE WHEN protected THEN 0.7::double ELSE 0.15::double END}}, {{'n': 'urban', 'x': CASE WHEN is_urban THEN p5 * 0.15::double ELSE 0.01::double END}}, {{'n': 'volcanic', 'x': 0.005::double}}, {{'n': 'unknown', 'x': 0.8::double * p5}}] AS l FROM c),
fl AS (SELECT id, class, has_weather, unnest(l) AS e, greatest(0.001::double, l[1].x) + greatest(0.001::double, l[2].x) + greatest(0.001::double, l[3].x) + greatest(0.001::double, l[4].x) + greatest(0.001::double, l[5].x) + greatest(0.001::double, l[6].x) + greatest(0.001::double, l[7].x) AS total FROM sp)
SELECT id, e.n AS source, {up('greatest(0.001::double, e.x) / total', 4)} AS p, CASE class WHEN 'vegetation_fire' THEN 'fire_radiative_power' WHEN 'controlled_heat_source' THEN 'land_management_status' WHEN 'unknown' THEN 'satellite_confidence' ELSE 'industrial_proximity' END AS driver,
 CASE class WHEN 'vegetation_fire' THEN 0.35::double WHEN 'controlled_heat_source' THEN 0.35::double ELSE 0.40::double END AS driver_weight FROM fl"""
