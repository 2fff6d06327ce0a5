"""The service end to end, and context names."""

from pyspark.sql import functions as F

from cinderflow.functions import text
from cinderflow.operators import intelligence, summary
from cinderflow.operators.filters import HotspotFilter
from cinderflow.plans.api import Service
from cinderflow.sources import context, ingest

from .test_operators import raw


def test_service(spark, tmp_path):
    s = Service(spark, str(tmp_path))
    assert s.health().first().data_mode == "demo"
    live = raw(spark).unionByName(raw(spark, frp="140", latitude="35")).unionByName(raw(spark, frp="60", latitude="36"))
    first = s.refresh([(None, "live", ""), (live, "cache", "cached")], "2026-10-02", "2026-10-02T00:00:00Z").first()
    assert (first.status, first.ingested) == ("success", 3)  # what a cache has was live
    again = s.refresh([(live, "live", "fetched")], "2026-10-02", "2026-10-03T00:00:00Z").first()
    assert (again.status, again.ingested) == ("success", 3)
    assert s.health().first().last_sync == "2026-10-03T00:00:00Z"
    rows, total = s.hotspots(HotspotFilter(min_frp=50.0), 1, 1)
    assert [r.frp for r in rows.collect()] == [140.0] and total.first().total == 2 and total.first().data_mode == "live"
    assert s.generate_alerts() == 2 and s.orphaned_alerts().count() == 0
    feed, unread = s.alerts()
    gravest = feed.first()
    assert gravest.severity == "critical" and unread.first().unread == 2
    assert s.acknowledge(gravest.id) and not s.acknowledge("nobody") and s.alerts()[1].first().unread == 1
    k = s.summary().first()
    assert k.total == 3 and k.n_critical == 1 and k.unread == 1
    assert s.sources().first().n == 3
    one = s.detail(rows.first().id).first()
    assert one.land_cover == "unclassified_terrain" and one.timeline[0].type == "detection"
    assert s.detail("nobody").count() == 0
    broken = raw(spark).withColumn("frp", F.raise_error(F.lit("broken feed")).cast("string"))
    sample = (raw(spark, latitude="37"), "demo", "sample")
    reloaded = s.refresh([(broken, "live", ""), sample], "2026-10-02", "2026-10-04T00:00:00Z").first()
    assert (reloaded.status, reloaded.ingested) == ("fallback_sample", 1) and "reloaded" in reloaded.message and s.health().first().data_mode == "demo"
    failed = s.refresh([(broken, "live", "")], "2026-10-02", "2026-10-05T00:00:00Z").first()
    assert failed.status == "error" and s.health().first().last_sync == "2026-10-04T00:00:00Z"  # nothing half done
    assert s.clear() == 4 and s.hotspots()[1].first().total == 0


def test_context_names(spark):
    rows = spark.sql("select 'x' as id, '800' as industrial_dist_m, named_struct('rh', '12.5', 'temp', 'NaN') as weather, named_struct('prior_detections', 3.9, 'is_recurrent', 'yes') as historical")
    r = context.resolved(rows).first()
    assert (r.distance_industrial_m, r.humidity, r.temperature, r.prior_30d, r.is_recurrent, r.land_cover) == (800.0, 12.5, None, 3, True, None)
    text = spark.createDataFrame([("x", '{"land_cover": "forest"}', "broken", None)], "id string, geospatial string, weather string, historical string")
    r = context.decoded(text).first()
    assert r.geospatial.land_cover == "forest" and r.historical is None and (r.weather is None or r.weather.wind_speed_kmh is None)
    back = context.encoded(context.decoded(text)).first()
    assert "forest" in back.geospatial
    assert context.resolved(context.decoded(text)).select(F.col("land_cover")).first().land_cover == "forest"


def test_input_of_any_shape(spark):
    """Names, gaps, texts that are no numbers, labels and scores of confidences."""
    rows = spark.createDataFrame(
        [
            ("a", None, "12.5", "0", "330", "HIGH", None),
            (" ", "b", "-3", "341", None, "0.3", "d"),
            (None, None, None, None, "0", "85", "n"),
            ("c", "d", "NaN", "x", None, None, " "),
            ("e", None, "1", "1", None, "1", "D"),
        ],
        "id string, hotspot_id string, frp string, brightness string, bright_ti4 string, confidence string, daynight string",
    )
    got = [tuple(r) for r in intelligence.input_normalized(rows).select("id", "frp", "brightness", "confidence", "confidence_score", "satellite", "daynight", "latitude").collect()]
    assert got == [
        ("a", 12.5, 330.0, "high", 0.95, "VIIRS", None, None),
        ("b", 0.0, 341.0, "low", 0.3, "VIIRS", "D", None),
        ("UNKNOWN-HOTSPOT", 0.0, 310.0, "high", 0.85, "VIIRS", "N", None),
        ("c", 0.0, 310.0, "nominal", 0.65, "VIIRS", None, None),
        ("e", 1.0, 1.0, "high", 1.0, "VIIRS", "D", None),
    ]
    assert intelligence.input_normalized(rows.select("frp").limit(0)).count() == 0


def test_shown_texts(spark):
    rows = spark.sql("select * from values (999.5d, cast(null as double), 'CRITICAL', 'Prescribed_Burn', 'bad'), (cast(null as double), -0.05d, null, null, null), (1949.9d, 0d, 'x', 'urban', '2024-03-05T06:07:08Z') as t(m, v, k, s, at)")
    got = [tuple(r) for r in rows.select(text.distance(F.col("m")), text.megawatts(F.col("v")), text.celsius(F.col("v")), text.level_label(F.col("k")), text.severity_label(F.col("k")), text.source_label(F.col("s")), text.timestamp(F.col("at"))).collect()]
    assert got == [
        ("1000 m", "0.0 MW", "\u2014", "CRITICAL", "CRITICAL", "Prescribed Burn", "bad"),
        ("N/A", "0.0 MW", "0.0\u00b0C", "LOW", "ADVISORY", "Unknown Source", "\u2014"),
        ("1.9 km", "0.0 MW", "0.0\u00b0C", "LOW", "ADVISORY", "Urban / Structure", "Mar 5, 06:07:08"),
    ]
    assert rows.select(text.coordinates(F.col("m"), F.col("v"))).first()[0] == "\u2014"


def test_charts(spark):
    rows = spark.createDataFrame([("A-1-2", 5.0, 1.0, "Here, TX"), ("plain", 7.0, 2.0, None), ("B-", 7.0, 3.0, ", x")], "id string, frp double, risk_score double, nearest_place string")
    assert [tuple(r) for r in summary.chart_peaks(rows).collect()] == [("", 7.0, 3.0, "Unknown"), ("", 7.0, 2.0, "Unknown"), ("1-2", 5.0, 1.0, "Here")]


def test_landings(spark, tmp_path):
    """An error page is passed over; what comes from a cache was live; records a line and an array a file give the same rows."""
    page, rows = str(tmp_path / "page"), str(tmp_path / "rows")
    spark.createDataFrame([("Invalid MAP_KEY",)], "t string").write.text(page)
    raw(spark).write.option("header", True).csv(rows)
    assert ingest.landed_csv(spark, page) is None
    found, mode, _ = ingest.fallback([(ingest.landed_csv(spark, page), "live", ""), (ingest.landed_csv(spark, rows), "cache", "cached")])
    assert mode == "live" and [r.data_mode for r in found.collect()] == ["live"]
    lines, array = tmp_path / "lines.json", tmp_path / "array.json"
    lines.write_text('{"a": 1, "b": "x"}\n{"a": 2.5}\n')
    array.write_text('[{"a": 1, "b": "x"}, {"a": 2.5}]')
    assert sorted(map(tuple, ingest.read_json(spark, str(lines), lines=True).collect())) == sorted(map(tuple, ingest.read_json(spark, str(array)).collect())) == [("1", "x"), ("2.5", None)]


def test_seed(spark, tmp_path):
    s = Service(spark, str(tmp_path))
    one = spark.createDataFrame([("a", 1.0)], "id string, frp double")
    assert s.seed({"hotspots": one.limit(0)}) and s.seed({"hotspots": one}) and not s.seed({"hotspots": one}) and s._table("hotspots").count() == 1
