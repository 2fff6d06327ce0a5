"""Known values of the operators, and properties of the order-dependent ones."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from cinderflow.functions import geo, scores
from cinderflow.operators import alerts, enrich, forest, graph, history, incidents, intelligence, spatial, store, summary
from cinderflow.operators.filters import page
from cinderflow.plans import queries
from cinderflow.sources import ingest
from cinderflow.streaming import refresh

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def raw(spark, **given):
    row = {"latitude": "34.5", "longitude": "-118.2", "bright_ti4": "330", "frp": "10", "acq_date": "2026-10-01", "acq_time": "845", "satellite": "N", "confidence": "n", "daynight": ""} | given
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))


@pytest.mark.parametrize("code,name", [("N", "Suomi-NPP"), ("1", "NOAA-20"), ("2", "NOAA-21"), ("T", "Terra"), ("A", "Aqua"), ("", "Suomi-NPP"), ("zz", "zz")])
def test_satellite(spark, code, name):
    assert ingest.normalized(raw(spark, satellite=code), "2026-10-02").first().satellite == name


@pytest.mark.parametrize("text,label", [("h", "high"), ("High", "high"), ("n", "nominal"), ("l", "low"), ("85", "high"), ("45", "nominal"), ("15", "low"), (None, "nominal")])
def test_confidence(spark, text, label):
    assert ingest.normalized(raw(spark, confidence=text), "2026-10-02").first().confidence == label


@pytest.mark.parametrize("text,time,flag", [("D", "0200", "D"), ("day", "0200", "D"), ("N", "1400", "N"), (None, "1400", "D"), (None, "0200", "N")])
def test_daynight(spark, text, time, flag):
    assert ingest.normalized(raw(spark, daynight=text, acq_time=time), "2026-10-02").first().daynight == flag


@pytest.mark.parametrize("bad", [{"latitude": "95"}, {"longitude": "-195"}, {"latitude": ""}, {"bright_ti4": ""}, {"bright_ti4": "-10"}, {"latitude": "NaN"}, {"bright_ti4": "1001"}])
def test_rejects(spark, bad):
    assert ingest.normalized(raw(spark, **bad), "2026-10-02").count() == 0


def test_normalized_values(spark):
    row = ingest.normalized(raw(spark, frp="142.8"), "2026-10-02").first()
    assert (row.acq_time, row.risk_level, row.is_anomaly, row.latitude) == ("0845", "critical", True, 34.5)
    assert ingest.normalized(raw(spark, frp="76.5"), "2026-10-02").first().risk_level == "high"
    assert ingest.normalized(raw(spark, latitude="0"), "2026-10-02").count() == 1
    again = ingest.normalized(raw(spark, frp="142.8"), "2026-10-02").first()
    assert again.id == row.id and row.id.startswith("VIIRS-SUOMINPP-20261001-")
    made = spark.range(1).select(ingest.sequence_id(F.lit("VIIRS"), F.lit("Suomi-NPP"), F.lit("2026-10-01"), F.lit(1)).alias("x")).first().x
    assert made == "VIIRS-SUOMINPP-20261001-0001"


def test_numbered_is_contiguous(spark):
    rows = ingest.numbered(spark.range(1000).select((F.lit(2000) - F.col("id")).alias("v")).repartition(7), ["v"])
    got = [(r.v, r.sequence) for r in rows.orderBy("v").collect()]
    assert [s for _, s in got] == list(range(1, 1001)) and got[0][0] == 1001


def test_read_csv_and_fallback(spark, tmp_path):
    (tmp_path / "a.csv").write_text("latitude,longitude,bright_ti4,frp,acq_date,acq_time,satellite,confidence,daynight\n34,-118,330,20,2026-10-01,845,N,n,D\n,,,,,,,,\n")
    (tmp_path / "bad.txt").write_text("<html>Invalid key</html>\n")
    rows = ingest.normalized(ingest.read_csv(spark, str(tmp_path / "a.csv")), "2026-10-02")
    assert rows.count() == 1
    assert ingest.looks_like_error(spark, str(tmp_path / "bad.txt")) and not ingest.looks_like_error(spark, str(tmp_path / "a.csv"))
    found, mode, _ = ingest.fallback([(None, "live", ""), (rows.limit(0), "cache", ""), (rows, "demo", "bundled")])
    assert mode == "demo" and found.first().data_mode == "demo"


def test_distances(spark):
    km = lambda a, b, c, d: one(spark, geo.haversine_m(*map(F.lit, (a, b, c, d)))) / 1000
    assert km(1.0, 2.0, 1.0, 2.0) == 0
    assert 340 <= km(51.5074, -0.1278, 48.8566, 2.3522) <= 348
    assert 550 <= km(37.7749, -122.4194, 34.0522, -118.2437) <= 570


@pytest.mark.parametrize("deg,name", [(0, "N"), (360, "N"), (42, "NE"), (90, "E"), (160, "SSE"), (180, "S"), (225, "SW"), (270, "W"), (315, "NW"), (float("nan"), "N/A")])
def test_compass(spark, deg, name):
    assert one(spark, geo.compass(F.lit(float(deg)))) == name


@pytest.mark.parametrize("lat", [0.0, 45.0, 69.9, 85.0, -60.0])
def test_cell_join_misses_nothing(spark, lat):
    """Against all pairs, near a pole and across the date line's neighbourhood."""
    points = spark.range(60).select(F.col("id").cast("string").alias("id"), (F.lit(lat) + (F.col("id") % 8 - 4) * 0.004).alias("latitude"), (F.lit(179.98) + (F.col("id") % 7) * 0.005).alias("lon"))
    points = points.select("id", "latitude", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")).alias("longitude"))
    right = spatial.as_right(points, "id")
    got = {(r.id, r.r_id) for r in spatial.within(points, right, 1000.0).collect()}
    distance = geo.haversine_m(F.col("latitude"), F.col("longitude"), F.col("r_latitude"), F.col("r_longitude"))
    every = {(r.id, r.r_id) for r in points.join(right, F.lit(True)).where(distance <= 1000).collect()}
    assert got == every and len(every) > 60


def test_plans_have_no_nested_loop(spark):
    for name in ("recurrence", "nearest_feature", "incident_edges", "geo_context"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name


def test_a_hot_site_is_split(spark):
    """A third of all points in one cell: its partition is dealt to several tasks, and no pair is lost or doubled."""
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        n = 3000
        points = spark.range(0, n, 1, 8).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, 34.0 + F.col("id") * 1e-7).otherwise(34.0 + F.col("id") * 0.01 % 20).alias("latitude"), F.lit(-118.0).alias("longitude"))
        right = spatial.as_right(points.where("id % 30 = 0"), "id")
        found = spatial.within(points, right, 500.0)
        got = sorted((r.id, r.r_id) for r in found.select("id", "r_id").collect())
        distance = geo.haversine_m(F.col("latitude"), F.col("longitude"), F.col("r_latitude"), F.col("r_longitude"))
        assert got == sorted((r.id, r.r_id) for r in points.crossJoin(right).where(distance <= 500).select("id", "r_id").collect()) and len(got) > 100_000
        counted = found.select("id", "r_id")
        counted.collect()
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_fire_weather(spark):
    f = lambda *x: one(spark, scores.fire_weather_index(*map(F.lit, map(float, x))))
    assert f(32, 12, 40, 60, 0) >= 80 and f(14, 85, 8, 12, 5) <= 20


def history_rows(spark, days, frp=30.0):
    rows = [(f"h{i}", 34.0, -118.0, f"2026-09-{d:02d}", "1200", frp) for i, d in enumerate(days)] + [("far", 35.0, -118.0, "2026-09-28", "1200", frp), ("t", 34.001, -118.0, "2026-09-30", "1200", 25.0)]
    return spark.createDataFrame(rows, "id string, latitude double, longitude double, acq_date string, acq_time string, frp double")


def test_recurrence(spark):
    row = history.recurrence(history_rows(spark, [28, 29, 30], 50.0)).where("id = 't'").first()
    assert (row.prior_30d, row.prior_90d, row.is_recurrent, row.first_date, row.pattern) == (3, 3, True, "2026-09-28", "persistent_burn")
    row = history.recurrence(history_rows(spark, range(10, 22))).where("id = 't'").first()
    assert row.pattern == "known_industrial_stack" and row.frequency >= 0.5
    row = history.recurrence(history_rows(spark, [])).where("id = 't'").first()
    assert (row.prior_30d, row.pattern, row.first_date) == (0, "none", None)


def test_recurrence_at_a_hot_place(spark):
    """A place with most rows, another in reach, one out of reach, rows without date or position: the same as from all pairs."""
    made = [(f"a{k}", 34.0, -118.0, f"2026-0{6 + k % 3}-{1 + k % 27:02d}", float(k % 70)) for k in range(900)]
    made += [(f"b{k}", 34.005, -118.0, f"2026-08-{1 + k:02d}", 80.0) for k in range(20)] + [("c", 35.0, -118.0, "2026-08-20", 5.0), ("d", 34.0, -118.0, "never", 5.0), ("e", None, -118.0, "2026-08-20", 5.0), ("f", float("nan"), -118.0, "2026-08-20", 5.0)]
    rows = spark.createDataFrame(made, "id string, latitude double, longitude double, acq_date string, frp double")
    got = {r.id: (r.prior_30d, r.prior_90d, r.persistence, r.first_date) for r in history.recurrence(rows).collect()}
    dated = [(i, lat, date.fromisoformat(day)) for i, lat, _, day, _ in made if day != "never" and lat is not None and lat == lat]
    for i, lat, _, day, _ in made:
        past = [] if day == "never" or lat is None or lat != lat else [d for j, other, d in dated if j != i and abs(other - lat) < 0.008 and d <= date.fromisoformat(day)]
        ages = [(date.fromisoformat(day) - d).days for d in past]
        short = {a for a in ages if a <= 30}
        want = (sum(a <= 30 for a in ages), sum(a <= 90 for a in ages), min(1.0, math.floor(len(short) / 7 * 100 + 0.5) / 100), str(min(past)) if past else None)
        assert got.pop(i) == want, i
    assert not got


def scored(spark, **given):
    kinds = {"id": "string", "frp": "double", "brightness": "double", "confidence": "string"} | intelligence.CONTEXT
    row = {"id": "x", "frp": 10.0, "brightness": 330.0, "confidence": "nominal"} | given
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[k]}" for k in row))
    return intelligence.analyzed(frame).first()


def test_scenarios(spark):
    r = scored(spark, frp=165.0, confidence="high", land_cover="industrial", distance_industrial_m=120.0, nearby_industrial=4, prior_30d=2)
    assert r.source == "industrial" and r.risk >= 50 and r.class_confidence >= 0.7
    r = scored(spark, frp=142.8, confidence="high", land_cover="dense_coniferous_forest", wind=42.0, humidity=14.0, temperature=35.0, distance_settlement_m=1200.0, slope=28.5)
    assert r.source == "wildfire" and r.risk >= 65 and r.is_outlier
    r = scored(spark, frp=38.0, land_cover="industrial", distance_industrial_m=100.0, prior_30d=32, is_recurrent=True, persistence=0.92)
    assert r.source == "industrial" and not r.is_outlier and r.outlier_score <= 0.30 and any("recurrent" in f.factor for f in r.factors)
    r = scored(spark, frp=18.5, land_cover="managed_coniferous_forest", is_protected=True)
    assert r.source == "prescribed_burn" and r.risk < 50
    r = scored(spark, frp=6.2, confidence="low")
    assert r.source == "unknown" and r.class_confidence <= 0.6 and r.risk < 30
    r = scored(spark, frp=320.0, confidence="high", land_cover="forest", wind=52.0, humidity=11.0, prior_30d=0, distance_settlement_m=900.0)
    assert r.outlier_score >= 0.85 and r.level == "critical"
    r = scored(spark, frp=45.0)
    assert 0 <= r.risk <= 100 and len(r.factors) >= 2 and abs(sum(v for k, v in r.probabilities.items() if not k.startswith("class:")) - 1) < 0.01


@pytest.mark.parametrize("score,level", [(24.9, "low"), (25.0, "medium"), (49.9, "medium"), (50.0, "high"), (74.9, "high"), (75.0, "critical")])
def test_levels(spark, score, level):
    assert one(spark, scores.level_of(F.lit(score))) == level


def test_nan_stays_finite(spark):
    r = scored(spark, frp=float("nan"), brightness=float("nan"), temperature=float("nan"), slope=float("nan"))
    assert 0 <= r.risk <= 100


def test_zscore(spark):
    assert scored(spark, frp=25.0).deviation == 0 and not scored(spark, frp=25.0).is_outlier
    assert scored(spark, frp=145.0).deviation == 6 and scored(spark, frp=145.0).is_outlier
    r = scored(spark, frp=35.0, prior_30d=30)
    assert not r.is_outlier and r.outlier_score <= 0.25


def test_forest(spark):
    rows = [(f"n{i}", 20.0 + i, 320.0 + i, "nominal") for i in range(8)] + [("odd", 280.0, 450.0, "nominal")]
    frame = intelligence.features(spark.createDataFrame(rows, "id string, frp double, brightness double, confidence string"))
    a = {r.id: r for r in forest.anomalies(frame).collect()}
    assert a["odd"].is_outlier and a["odd"].outlier_score >= max(r.outlier_score for r in a.values())
    assert a == {r.id: r for r in forest.anomalies(frame.repartition(3)).collect()}
    assert forest.anomalies(frame.limit(2)).count() == 2


def test_forest_flags_the_share_of_all_rows_and_every_tree_has_its_own_sample(spark):
    hashed = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10_000)) / 10_000.0)
    rows = spark.range(5000).select(F.concat(F.lit("n"), F.col("id")).alias("id")).select("id", (100 * hashed(1)).alias("f_frp"), (300 + 50 * hashed(2)).alias("f_brightness"), hashed(3).alias("persistence_score"))
    got = {r.id: r for r in forest.anomaly_forest(rows).collect()}
    assert max(abs(r.deviation) for r in got.values()) < 2  # so the score alone flags
    assert sum(r.is_outlier for r in got.values()) == 500
    assert got == {r.id: r for r in forest.anomaly_forest(rows.repartition(7)).collect()}
    samples = forest.sub_samples(rows, 256, 4, 42)
    assert all(x.shape == (256, 3) for x in samples) and len({tuple(map(tuple, x)) for x in samples}) == 4
    assert forest.sub_samples(rows.limit(20), 256, 2, 42)[0].shape == (20, 3)


def test_forest_falls_back(spark):
    """Where a value isn't finite no forest is fitted; the fixed baseline decides."""
    rows = [(f"n{i}", 20.0 + i, 320.0 + i, "nominal") for i in range(8)]
    frame = intelligence.features(spark.createDataFrame([*rows, ("odd", 280.0, float("nan"), "nominal")], "id string, frp double, brightness double, confidence string"))
    with pytest.raises(forest.Unfit):
        forest.anomaly_forest(frame)
    got = {r.id: (r.is_outlier, r.deviation) for r in forest.anomalies(frame).collect()}
    assert got == {r.id: (r.is_outlier, r.deviation) for r in intelligence.anomaly_zscore(frame).collect()} and got["odd"][0]
    assert forest.anomalies(frame.limit(0)).count() == 0


def test_batch_of_three_takes_the_baseline_and_a_larger_one_the_forest(spark):
    rows = [(f"n{i}", x, 320.0, "nominal") for i, x in enumerate((12.0, 22.0, 28.0))]
    three = intelligence.batch_analyzed(spark.createDataFrame(rows, "id string, frp double, brightness double, confidence string")).collect()
    assert len(three) == 3 and not any(r.population for r in three) and all("baseline" in r.rationale for r in three)
    many = [(f"n{i}", 20.0 + i, 320.0 + i, "nominal") for i in range(8)] + [("odd", 280.0, 450.0, "nominal")]
    got = {r.id: r for r in intelligence.batch_analyzed(spark.createDataFrame(many, "id string, frp double, brightness double, confidence string")).collect()}
    assert all(r.population for r in got.values()) and got["odd"].is_outlier and got["odd"].rationale.startswith("Stands out") and got["odd"].outlier_score >= 0.65


def test_forest_nodes_lead_every_row_to_a_leaf(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    for x in (rng.random((256, 3)), np.repeat(rng.random((4, 3)), 20, 0), np.ones((9, 3)), rng.integers(0, 2, (50, 3)).astype(float)):
        tree = forest.grow(x, 3, 42, 8)
        inner = tree.feature >= 0
        assert (tree.left[inner] > 0).all() and (tree.right[inner] > 0).all() and tree.size[0] == len(x)
        assert all(tree.size[k] == tree.size[tree.left[k]] + tree.size[tree.right[k]] for k in np.flatnonzero(inner))
        depth = forest.walk(tree, x)
        assert (depth >= 0).all() and depth.max() <= 8 * forest.UNIT + forest.usual_depth(len(x)) * forest.UNIT + 1
    table = forest.node_table(spark, [forest.grow(rng.random((256, 3)), 0, 42, 8)])
    assert table.where("feature is null and depth is null").count() == 0 and table.where("path = ''").first().size == 256


def spots(spark, rows):
    return spark.createDataFrame(rows, "id string, latitude double, longitude double, acq_date string, acq_time string, source_type string, cluster_id string, risk_score double, risk_level string, frp double, is_anomaly boolean").withColumn("last_updated", F.lit(None).cast("string"))


def test_incidents(spark):
    two = [("a", 34.0, -118.0, "2026-10-01", "1200", "wildfire", None, 60.0, "high", 50.0, False), ("b", 34.001, -118.0, "2026-10-01", "1300", "wildfire", None, 90.0, "critical", 80.0, True)]
    row = incidents.aggregated(spots(spark, two)).collect()
    assert len(row) == 1 and row[0].primary_id == "b" and row[0].status == "active" and row[0].hotspot_ids == ["a", "b"]
    apart = [two[0], ("b", 39.0, *two[1][2:])]
    assert incidents.aggregated(spots(spark, apart)).count() == 2
    assert incidents.aggregated(spots(spark, two).limit(0)).count() == 0


def greedy(ids, neighbours):
    """id -> seed of its group, by one global fold: seeds come in the given order; one pass over the later ids lets those join
    that are near any member so far; who was passed over isn't asked again."""
    group = {}
    for i, seed in enumerate(ids):
        if seed in group:
            continue
        group[seed] = seed
        reach = set(neighbours.get(seed, ()))
        for other in ids[i + 1 :]:
            if other not in group and other in reach:
                group[other] = seed
                reach |= neighbours.get(other, set())
    return group


def test_greedy_is_not_components():
    near = {"A": {"C"}, "C": {"A", "B"}, "B": {"C"}}
    assert greedy(["A", "B", "C"], near) == {"A": "A", "C": "A", "B": "B"}  # B was passed over before C joined


def test_clusters_equal_one_global_fold(spark):
    rows = queries.T.hotspots(spark, DATA).orderBy("id").limit(300)
    edges = [(r.a, r.b) for r in incidents.edges(rows).collect()]
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    order = [r.id for r in rows.orderBy(F.desc("risk_score"), F.desc("frp"), "id").collect()]
    assert {r.id: r.seed for r in incidents.clusters(rows).collect()} == greedy(order, near)


def test_clusters_hold_no_component_in_one_place(spark):
    """A hot site, long chains and ties, in rounds over the edge table, against the fold."""
    hot = [(f"h{i:03d}", 34.0 + (i * 7 % 13) * 0.0001, -118.0, (i * 31 % 17) * 5.0) for i in range(60)]
    up = [(f"u{i:03d}", 36.0 + i * 0.012, -118.0, 90.0 - i) for i in range(30)]
    mixed = [(f"m{i:03d}", 38.0 + i * 0.007, -118.0, i * 37 % 11 * 8.0) for i in range(60)]
    rows = spots(spark, [(i, lat, lon, "2026-10-01", "1200", "wildfire", None, risk, "high", 5.0, False) for i, lat, lon, risk in hot + up + mixed])
    near: dict = {}
    for r in incidents.edges(rows).collect():
        near.setdefault(r.a, set()).add(r.b)
        near.setdefault(r.b, set()).add(r.a)
    order = [r.id for r in rows.orderBy(F.desc("risk_score"), F.desc("frp"), "id").collect()]
    found = incidents.clusters(rows)
    assert {r.id: r.seed for r in found.collect()} == greedy(order, near)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "collect_set" not in plan


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (None, 3)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def alert_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, hotspot_id string, severity string, risk_score double, is_acknowledged boolean, timestamp string, seq long")


def test_alert_dedup(spark):
    a = alert_rows(spark, [("1", "h", "critical", 85.0, False, "", 1), ("2", "h", "critical", 92.0, False, "", 2), ("3", "h", "warning", 60.0, False, "", 3)])
    got = {(r.severity, r.risk_score) for r in alerts.deduplicated(a, "seq").collect()}
    assert got == {("critical", 92.0), ("warning", 60.0)}
    b = alert_rows(spark, [("1", "h", "critical", 85.0, True, "", 1), ("2", "h", "critical", 92.0, False, "", 2)])
    r = alerts.deduplicated(b, "seq").first()
    assert (r.id, r.is_acknowledged) == ("2", True)
    once = alerts.deduplicated(a, "seq")
    assert sorted(alerts.deduplicated(once, "seq").collect()) == sorted(once.collect())


def test_alert_feed(spark):
    a = alert_rows(spark, [("i", "1", "info", 40.0, False, "", 1), ("w", "2", "warning", 70.0, True, "", 2), ("c", "3", "critical", 90.0, False, "", 3), ("d", "4", "critical", 95.0, False, "", 4)])
    assert [r.risk_score for r in alerts.feed(a).collect()] == [95, 90, 70, 40]
    assert alerts.unread(a).first().unread == 3 and alerts.unread(alerts.acknowledged(a, "c")).first().unread == 2


def test_kpis(spark):
    rows = spark.createDataFrame([("critical", 95.0, "wildfire", 120.0, True), ("high", 65.0, "wildfire", 60.0, False), ("high", 55.0, "industrial", 40.0, False), ("medium", 30.0, "wildfire", 20.0, False), ("low", 10.0, "urban", 10.0, False)], "risk_level string, risk_score double, source_type string, frp double, is_anomaly boolean")
    k = summary.kpis(rows).first()
    assert (k.total, k.n_critical, k.n_high, k.n_medium, k.n_low, k.avg_frp, k.max_frp, k.avg_risk, k.dominant_source) == (5, 1, 2, 1, 1, 50.0, 120.0, 51.0, "wildfire")
    empty = summary.kpis(rows.limit(0)).first()
    assert (empty.total, empty.avg_frp, empty.dominant_source) == (0, 0.0, "unknown")
    assert k.n_critical + k.n_high + k.n_medium + k.n_low == k.total


def test_page_limits(spark):
    with pytest.raises(ValueError):
        page(spark.range(1), 0, 50)
    with pytest.raises(ValueError):
        page(spark.range(1), 1, 501)


def test_store(spark, tmp_path):
    keys = {"t": "id", "m": "key"}
    box = store.Store(spark, str(tmp_path), 4)
    assert not box.has("t")
    old = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 0)], "id string, frp double, batch_seq long")
    new = spark.createDataFrame([("b", 3.0, 1), ("b", 4.0, 2), ("c", 5.0, 1)], "id string, frp double, batch_seq long")
    for rows in (old, new, new):
        box.commit(keys, {"t": rows})
    assert sorted(map(tuple, box.read("t").collect())) == [("a", 1.0), ("b", 4.0), ("c", 5.0)]
    box.commit(keys, wholes={"t": box.read("t").limit(0)})
    assert box.read("t").count() == 0 and box.read("t").columns == ["id", "frp"]


def test_store_leaves_untouched_buckets(spark, tmp_path):
    keys = {"t": "id"}
    box = store.Store(spark, str(tmp_path), 8)
    box.commit(keys, {"t": spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("v"), F.lit(0).alias("batch_seq"))})
    before = box.state()[1]["t"]
    box.commit(keys, {"t": spark.createDataFrame([("7", 1, 1)], "id string, v int, batch_seq long")})
    after = box.state()[1]["t"]
    assert sum(before[b] != after[b] for b in range(8)) == 1 and box.read("t").agg(F.sum("v")).first()[0] == 1 and box.read("t").count() == 200
    number = box.compact()
    assert box.state() == (number, {"t": after}) and len(box._log()) == 1
    gone = box.vacuum()
    assert any(g.startswith("t/") for g in gone) and not set(gone) & set(after.values()) and box.read("t").count() == 200


def test_a_commit_is_all_or_nothing(spark, tmp_path, monkeypatch):
    """A writer that stops before its log file, or within it, leaves both tables as they were; of two writers one wins."""
    keys = {"t": "id", "m": "key"}
    box = store.Store(spark, str(tmp_path), 2)
    rows = lambda v: {"t": spark.createDataFrame([("a", v, v)], "id string, v int, batch_seq long"), "m": spark.createDataFrame([("k", v, v)], "key string, v int, batch_seq long")}
    seen = lambda: (box.read("t").first().v, box.read("m").first().v)
    box.commit(keys, rows(1))
    with monkeypatch.context() as m:
        m.setattr(store.Store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            box.commit(keys, rows(2))
    assert seen() == (1, 1)
    (tmp_path / "log" / f"{2:020d}.json").write_text('{"tables": {"t"')  # cut off
    assert seen() == (1, 1) and box.state()[0] == 2
    assert box.commit(keys, rows(3)) == 3 and seen() == (3, 3)
    other = store.Store(spark, str(tmp_path), 2)
    now = other.state()
    box.commit(keys, rows(4))
    monkeypatch.setattr(other, "state", lambda: now)
    with pytest.raises(store.Conflict):
        other.commit(keys, rows(5))
    assert seen() == (4, 4)


def test_weather_without_data_has_nulls_inside_and_zeros_outside(spark):
    point = spark.createDataFrame([("x", 10.0, 10.0)], "id string, latitude double, longitude double")
    none = spark.createDataFrame([], "glat long, glon long, temperature double, humidity double, wind double, gust double, direction double, rain double")
    w = enrich.weather_context(point, none)
    assert w.first().humidity is None and enrich.presented(w).first().humidity == 0.0 and w.first().weather_status == "unavailable"


def test_stream_upsert(spark, tmp_path):
    feed = tmp_path / "in"
    raw(spark).write.parquet(str(feed))
    raw(spark, frp="99").write.mode("append").parquet(str(feed))
    stream = refresh.read_stream(spark, str(feed), raw(spark).schema)
    refresh.upsert_each_batch(stream, str(tmp_path / "out"), "2026-10-02", str(tmp_path / "state")).awaitTermination()
    assert store.Store(spark, str(tmp_path / "out")).read("hotspots").count() == 1


def test_upsert_of_equal_order_depends_on_rows_alone(spark):
    from cinderflow.operators import store

    old = spark.createDataFrame([(1, "old"), (2, "kept")], "id long, v string")
    new = [(1, "x", 5), (1, "y", 5), (1, "z", 4), (3, "n", 0)]
    for rows in (new, new[::-1]):
        got = store.upserted(old, spark.createDataFrame(rows, "id long, v string, batch_seq long").repartition(3))
        assert sorted(map(tuple, got.collect())) == [(1, "y"), (2, "kept"), (3, "n")]


def test_place_is_known_by_industry_count_but_not_by_slope(spark):
    from cinderflow.operators import intelligence

    rows = [("a", 9.0, 310.0, "n", 3.0, None), ("b", 9.0, 310.0, "n", None, 0), ("c", 9.0, 310.0, "n", None, None)]
    frame = spark.createDataFrame(rows, "id string, frp double, brightness double, confidence string, slope double, nearby_industrial long")
    assert {r.id: r.has_geo for r in intelligence.features(frame).select("id", "has_geo").collect()} == {"a": False, "b": True, "c": False}


def test_weather_of_a_cell_with_several_rows_is_one_whole_row(spark):
    from cinderflow.operators import enrich

    points = spark.createDataFrame([("p", 30.0, -120.0)], "id string, latitude double, longitude double")
    rows = [(3000, -12000, 10.0, None, 5.0, None, 10.0, 0.0), (3000, -12000, 20.0, 40.0, None, None, 90.0, 1.0), (3000, -12000, None, 99.0, 9.0, 9.0, 9.0, 9.0)]
    weather = spark.createDataFrame(rows, "glat long, glon long, temperature double, humidity double, wind double, gust double, direction double, rain double")
    got = enrich.weather_context(points, weather.repartition(3)).first()
    assert (got.temperature, got.humidity, got.wind, got.rain) == (20.0, 40.0, 0.0, 1.0)  # an unknown wind counts as calm
