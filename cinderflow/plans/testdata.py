"""Hotspots, map features and weather made from the driver's tables by fixed arithmetic, so that SQL can make the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import baseline_risk
from .lineage import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(x: Column, values: dict[str, str]) -> Column:
    chain = F
    for k, v in values.items():
        chain = chain.when(x == k, v)
    return chain.otherwise("unknown")


SOURCE_OF = {"click": "wildfire", "view": "industrial", "purchase": "agricultural", "signup": "urban", "error": "volcanic"}
COVER_OF = {"click": "dense_coniferous_forest", "view": "industrial_site", "purchase": "cropland", "signup": "urban_wildland_interface", "error": "chaparral_scrubland"}


def positions() -> tuple[Column, Column]:
    e, u = F.col("event_id"), F.col("user_id")
    lat = 30.0 + (u % 50) * 0.05 + ((e % 11) - 5) * 0.001
    lon = -120.0 + F.floor(u / 50) * 0.05 + ((e % 7) - 3) * 0.001
    return lat, lon


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotspots_of(dealt(table(spark, sf_dir, "events")))


def hotspots_of(events: DataFrame) -> DataFrame:
    lat, lon = positions()
    e, u, frp = F.col("event_id"), F.col("user_id"), F.greatest(F.col("value"), F.lit(0.0))
    bright = 300 + F.col("value") * 0.4
    score, level, anomaly = baseline_risk(frp, bright)
    return events.select(
        F.concat(F.lit("EV-"), F.lpad(e.cast("string"), 9, "0")).alias("id"), "event_id", "user_id", lat.alias("latitude"), lon.alias("longitude"), bright.alias("brightness"),
        F.date_format("ts", "yyyy-MM-dd").alias("acq_date"), F.date_format("ts", "HHmm").alias("acq_time"), F.lit("Suomi-NPP").alias("satellite"), F.regexp_extract("props", "([0-9]+)", 1).alias("confidence"), frp.alias("frp"),
        choose(F.col("event_type"), SOURCE_OF).alias("source_type"), choose(F.col("event_type"), COVER_OF).alias("land_cover"), score.alias("risk_score"), level.alias("risk_level"), anomaly.alias("is_anomaly"),
        F.when(u % 10 == 0, F.concat(F.lit("C"), u.cast("string"))).alias("cluster_id"),
        F.concat(F.lit("Site "), u.cast("string"), F.lit(", "), F.element_at(F.array(*map(F.lit, ("CA", "TX", "OR", "HI"))), (u % 4 + 1).cast("int"))).alias("nearest_place"),
        F.lit(None).cast("string").alias("last_updated"),
    )


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy text rows, one in seventeen invalid."""
    lat, lon = positions()
    e, k = F.col("event_id"), F.regexp_extract("props", "([0-9]+)", 1)
    pick = lambda n, *xs: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs)), (e % n + 1).cast("int"))
    return dealt(table(spark, sf_dir, "events")).select(
        "event_id",
        F.when(e % 50 == 0, "95.0").otherwise(lat.cast("string")).alias("LATITUDE"),
        F.when(e % 50 == 2, "abc").otherwise(lon.cast("string")).alias("lon"),
        F.when(e % 50 == 1, "").otherwise((300 + F.col("value") * 0.4).cast("string")).alias("Bright_TI4"),
        F.when(e % 20 == 3, "").when(e % 20 == 4, "-5").otherwise(F.col("value").cast("string")).alias("frp"),
        F.date_format("ts", "yyyy-MM-dd").alias("acq_date"),
        (F.hour("ts") * 100 + F.minute("ts")).cast("string").alias("acq_time"),
        pick(8, "N", "1", "2", "T", "A", "snpp", " ", "X9").alias("satellite"),
        pick(5, "h", "L", "med", k, "").alias("confidence"),
        pick(3, "D", "night", "").alias("daynight"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kinds = {"BUILDING": "settlement", "AUTOMOBILE": "infrastructure", "MACHINERY": "industrial", "HOUSEHOLD": "protected_area", "FURNITURE": "natural"}
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("node/"), k.cast("string")).alias("id"), F.col("c_name").alias("name"), choose(F.col("c_mktsegment"), kinds).alias("category"),
        (30.0 + (k % 50) * 0.05 + 0.004).alias("latitude"), (-120.0 + (F.floor(k / 50) % 30) * 0.05 + 0.003).alias("longitude"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather on part of the two-decimal grid (in hundredths), from suppliers' keys, the stations."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        (3000 + (k % 50) * 5 + F.floor(k / 50) % 3 - 1).alias("glat"), (-12000 + (F.floor(k / 50) % 30) * 5).alias("glon"), (10.0 + k % 30).alias("temperature"), (k % 110).cast("double").alias("humidity"),
        (k % 60).cast("double").alias("wind"), F.when(k % 3 != 0, (k % 60 + 12).cast("double")).alias("gust"), (k * 37 % 720).cast("double").alias("direction"), F.when(k % 4 == 0, 1.5).otherwise(0.0).alias("rain"),
        k.alias("station"),
    )


def scoring_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hotspots with context by arithmetic, with gaps; one in sixty knows nothing of its place but the slope."""
    e = F.col("event_id")
    some = lambda test, value, kind="double": F.when(test, value.cast(kind))
    return hotspots(spark, sf_dir).withColumns({
        "distance_industrial_m": some(e % 3 != 0, (e * 13) % 4000), "nearby_industrial": some(e % 3 != 0, e % 5, "long"), "distance_settlement_m": some(e % 4 != 0, (e * 29) % 12000), "distance_infrastructure_m": some(e % 5 != 0, (e * 17) % 6000),
        "is_protected": F.when((e % 6 != 5) & (e % 60 != 0), e % 6 == 0), "land_cover": F.when(e % 60 != 0, F.col("land_cover")), "slope": some(e % 7 != 0, e % 60), "temperature": some(e % 8 != 0, e % 45), "humidity": some(e % 8 != 0, (e * 7) % 101), "wind": some(e % 8 != 0, (e * 3) % 70), "rain": some(e % 8 != 0, e % 3),
        "fwi": some(e % 9 == 1, e % 100), "prior_30d": some(e % 10 != 9, e % 25, "long"), "prior_90d": some(e % 10 != 9, e % 25 + e % 13, "long"), "is_recurrent": F.when(e % 10 != 9, e % 25 >= 20), "persistence": some(e % 11 == 0, (e % 100) / 100.0),
    })


def as_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OpenStreetMap-like elements from customers' keys."""
    k = F.col("c_custkey")
    pick = lambda *rows: F.element_at(F.array(*(F.create_map(*map(F.lit, r)) if r else F.create_map().cast("map<string,string>") for r in rows)), (k % len(rows) + 1).cast("int"))
    tags = pick(("landuse", "industrial", "name", "Plant"), ("man_made", "refinery"), ("industrial", "oil"), ("power", "plant", "plant:source", "gas"), ("power", "substation"), ("highway", "primary", "ref", "A1", "name", "Road"), ("pipeline", "yes", "substance", "gas"), ("place", "town", "name", "Ville"), ("boundary", "national_park"), ("leisure", "nature_reserve"), ("natural", "wood"), ("amenity", "cafe"))
    node = F.struct(F.lit("node").alias("type"), k.alias("id"), (k % 200 - 100).cast("double").alias("lat"), (k % 300 - 150).cast("double").alias("lon"), F.lit(None).cast("struct<lat: double, lon: double>").alias("center"), F.lit(None).cast("struct<minlat: double, minlon: double, maxlat: double, maxlon: double>").alias("bounds"), tags.alias("tags"))
    way = F.struct(F.lit("way").alias("type"), k.alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.when(k % 2 == 0, F.struct((k % 80).cast("double").alias("lat"), (k % 170).cast("double").alias("lon"))).alias("center"), F.when(k % 2 == 1, F.struct((k % 80).cast("double").alias("minlat"), (k % 170).cast("double").alias("minlon"), (k % 80 + 1).cast("double").alias("maxlat"), (k % 170 + 3).cast("double").alias("maxlon"))).alias("bounds"), tags.alias("tags"))
    return table(spark, sf_dir, "customer").select(F.array(node, way).alias("elements"))


def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several alerts for each of the sites' hotspots, some acknowledged, in order of seq."""
    return alerts_of(hotspots(spark, sf_dir))


def alerts_of(hotspots: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return hotspots.select(
        F.concat(F.lit("ALT-"), e.cast("string")).alias("id"), F.concat(F.lit("H"), (e % 700).cast("string")).alias("hotspot_id"), F.when(e % 3 == 0, "critical").when(e % 3 == 1, "warning").otherwise("info").alias("severity"),
        "risk_score", ((e * 7) % 5 == 0).alias("is_acknowledged"), F.concat("acq_date", F.lit("T"), F.substring("acq_time", 1, 2), F.lit(":"), F.substring("acq_time", 3, 2), F.lit(":00")).alias("timestamp"), e.alias("seq"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather payloads by supplier: an hourly series with gaps (an array that is shorter, one that is absent, values that are null or no
    numbers), a current block, and now and then broken text."""
    k = F.col("s_suppkey")
    hours = F.sequence(F.lit(0), (k % 24).cast("int"))
    each = lambda f: F.transform(hours, f)
    times = each(lambda h: F.when(h % 13 != 12, F.concat(F.lit("2024-01-01T"), F.lpad(h.cast("string"), 2, "0"), F.lit(":00"))))
    series = F.struct(
        times.alias("time"), each(lambda h: F.when((h + k) % 5 != 0, (h + k % 30).cast("string"))).alias("temperature_2m"), each(lambda h: ((h * 7 + k) % 130 - 10).cast("string")).alias("relative_humidity_2m"),
        F.slice(each(lambda h: F.when((h + k) % 7 == 0, "calm").otherwise(((h + k) % 40 - 2).cast("string"))), 1, 8).alias("wind_speed_10m"), F.when(k % 3 != 0, each(lambda h: (h * 50 % 720).cast("string"))).alias("wind_direction_10m"),
    )
    now = F.struct(F.when(k % 4 != 0, (k % 40).cast("string")).alias("temperature_2m"), F.when(k % 5 != 0, (k % 120).cast("string")).alias("relative_humidity_2m"), (k % 33 - 3).cast("string").alias("wind_speed_10m"), (k * 37 % 720).cast("string").alias("wind_direction_10m"))
    text = F.when(k % 17 == 0, "<html>busy</html>").otherwise(F.to_json(F.struct(series.alias("hourly"), now.alias("current"))))
    return table(spark, sf_dir, "supplier").select(k.alias("site"), text.alias("payload"))


def loose_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as texts under several names, with gaps and values that are no numbers."""
    lat, lon = positions()
    e, k = F.col("event_id"), F.regexp_extract("props", "([0-9]+)", 1)
    label = F.when(e % 7 == 0, "H").when(e % 7 == 1, "low").when(e % 7 == 2, "nominal").when(e % 7 == 3, F.concat(F.lit(" "), k)).when(e % 7 == 4, (k.cast("double") / 100).cast("string")).when(e % 7 == 5, "?")
    return dealt(table(spark, sf_dir, "events")).select(
        F.when(e % 3 == 0, F.concat(F.lit("A"), e.cast("string"))).alias("id"), F.when(e % 3 == 1, F.concat(F.lit("B"), e.cast("string"))).when(e % 3 == 2, F.when(e % 2 == 0, F.concat(F.lit("C"), e.cast("string"))).otherwise(" ")).alias("hotspot_id"),
        F.when(e % 11 == 0, "n/a").when(e % 11 == 1, "-4.5").when(e % 11 != 2, F.col("value").cast("string")).alias("frp"),
        F.when(e % 4 == 0, "0").when(e % 4 == 1, (300 + F.col("value") * 0.4).cast("string")).alias("brightness"), F.when(e % 8 < 6, (301 + F.col("value") * 0.4).cast("string")).alias("bright_ti4"),
        label.alias("confidence"), F.when(e % 2 == 0, "Terra").alias("satellite"), F.when(e % 5 == 0, "d").when(e % 5 == 1, "N").alias("daynight"),
        F.when(e % 13 != 0, lat).alias("latitude"), F.when(e % 13 != 1, lon.cast("string")).otherwise("west").alias("longitude"),
    )
