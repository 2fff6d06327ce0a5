"""What larger tables bring: sides of joins that are larger than their files, many features at one place, many stations in one cell."""

from pyspark.sql import functions as F

from cinderflow.operators import enrich, history, spatial
from cinderflow.plans import queries
from cinderflow.plans import testdata as T

DATA = "/root/testdata/sf0.001"


def broadcasts(df):
    """The broadcast joins of a plan but those of `numbered`, which has a row for each partition."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "__part" not in line]


def test_recurrence_sends_no_table_to_the_driver(spark):
    for name in ("recurrence", "recurrence_90d", "recurrence_7_30"):
        assert not broadcasts(queries.QUERIES[name](spark, DATA)), name


def test_the_whole_chain_sends_only_the_weather_to_the_driver(spark):
    """The grid of weather is an aggregate of a scan without lists, whose size is estimated well."""
    assert all("glat" in line for line in broadcasts(queries.analyzed_end_to_end(spark, DATA)))


def places_with_many_features(spark):
    points = spark.createDataFrame([("p", 34.0, -118.0), ("q", 34.001, -118.0), ("far", 10.0, 10.0), ("edge", 34.09, -118.15), ("r", 34.0, -118.0)], "id string, latitude double, longitude double")
    features = spark.range(1000).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), F.lit("x").alias("name"), F.when(F.col("id") % 2 == 0, "industrial").otherwise("settlement").alias("category"), F.lit(34.002).alias("latitude"), F.lit(-118.0).alias("longitude"))
    return points, features


def test_features_of_one_place_meet_a_point_once(spark, monkeypatch):
    points, features = places_with_many_features(spark)
    met, within = [], spatial.within
    for module in (spatial, enrich):
        monkeypatch.setattr(module, "within", lambda *a, **k: met.append(within(*a, **k)) or met[-1])
    near, context = spatial.nearest(points, features, 5000.0), enrich.geo_context(points, features)
    assert {(r.id, r.category, r.feature_id) for r in near.collect()} == {(p, c, f) for p in "pqr" for c, f in (("industrial", "n0000"), ("settlement", "n0001"))}
    assert {(r.id, r.nearest_industrial, r.nearby_industrial, r.nearby_settlement) for r in context.collect()} == {(p, "n0000", 500, 500) for p in "pqr"} | {(p, None, 0, 0) for p in ("far", "edge")}
    assert [pairs.count() for pairs in met] == [4, 4]  # two places, two kinds
    assert not broadcasts(near) and not broadcasts(context)


def test_counts_are_unknown_where_the_map_has_nothing(spark):
    points, features = places_with_many_features(spark)
    got = spatial.radius_counts(points, features, {"industrial": 5000.0, "settlement": 100.0}, mapped=(0.1, 0.2))
    assert {(r.id, r.n_industrial, r.n_settlement) for r in got.collect()} == {("p", 500, 0), ("q", 500, 0), ("r", 500, 0), ("edge", 0, 0), ("far", None, None)}
    got = spatial.radius_counts(points, features, {"industrial": 5000.0})
    assert {(r.id, r.n_industrial) for r in got.collect()} == {("p", 500), ("q", 500), ("r", 500), ("edge", 0), ("far", 0)}


def test_the_first_station_of_a_cell_counts(spark):
    points = spark.createDataFrame([("p", 30.0, -120.0)], "id string, latitude double, longitude double")
    rows = [(3000, -12000, t, 40.0, 5.0, None, 90.0, 1.0, s) for s, t in ((9, 30.0), (2, 10.0), (4, 20.0))]
    weather = spark.createDataFrame(rows, "glat long, glon long, temperature double, humidity double, wind double, gust double, direction double, rain double, station long")
    assert enrich.weather_context(points, weather.repartition(3), first_by="station").first().temperature == 10.0
    assert enrich.weather_context(points, weather.repartition(3)).first().temperature == 30.0


def test_stations_of_one_cell_in_the_queries(spark, tmp_path):
    """Suppliers 3,000 apart lie in one cell: both queries take the first, like their SQL."""
    suppliers = spark.read.parquet(f"{DATA}/supplier.parquet")
    suppliers.unionByName(suppliers.withColumn("s_suppkey", F.col("s_suppkey") + 4500)).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    alone = lambda name, folder: sorted(map(tuple, queries.QUERIES[name](spark, str(folder)).collect()))
    assert T.weather(spark, str(tmp_path)).groupBy("glat", "glon").count().where("count > 1").count() > 0
    for name in ("weather_grid_join", "weather_texts"):
        assert alone(name, tmp_path) == alone(name, DATA), name


def test_wide_cells_miss_nothing(spark):
    """Cells of three radii: the same pairs as from cells of one, at a pole and across the date line too, with fewer copies of the right rows."""
    u = lambda k: F.rand(k)
    made = spark.range(0, 600, 1, 1).select(F.col("id"), F.when(F.col("id") % 3 == 0, 89.9 + u(1) * 0.1).otherwise(50 + u(2) * 0.1).alias("latitude"), F.when(F.col("id") % 3 == 2, 179.95 + u(3) * 0.05).when(F.col("id") % 3 == 1, -180 + u(4) * 0.05).otherwise(u(5) * 360 - 180).alias("longitude"))
    rows = spark.createDataFrame(made.collect(), made.schema)
    right = spatial.as_right(rows, "id")
    pairs = [sorted(map(tuple, spatial.within(rows, right, 1500.0, wide=w).select("id", "r_id").collect())) for w in (1.0, 3.0)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 2000
    copies = [spatial.spread(right.where("r_latitude < 60"), 1500.0, "r_latitude", "r_longitude", c).count() for c in (1500.0, 4500.0)]
    assert copies[1] < 0.5 * copies[0]


def test_rounds_over_incidents_are_on_longs(spark, monkeypatch):
    """What a round passes on is two longs a row, and no rows of texts or structs."""
    from cinderflow.operators import graph, incidents

    kept, staged = [], incidents.staged
    for module in (incidents, graph):
        monkeypatch.setattr(module, "staged", lambda df, name: kept.append((name, set(dict(df.dtypes).values()))) or staged(df, name))
    rows = T.hotspots(spark, DATA)
    incidents.clusters(rows), incidents.components(rows)
    rounds = [kinds for name, kinds in kept if name in ("incident-edges", "incident-seeds", "edges")]
    assert len(rounds) > 6 and all(kinds == {"bigint"} for kinds in rounds)


def test_one_row_group_is_dealt_to_many_tasks(spark, tmp_path):
    """A file that Spark plans as many partitions, all of whose rows lie in one row group and so in one of them."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from cinderflow.plans.lineage import SHARE, dealt

    import os

    n = 400_000
    pq.write_table(pa.table({"k": list(range(n)), "t": pa.array([os.urandom(24) for _ in range(n)])}), tmp_path / "one.parquet", row_group_size=n)
    scan = spark.read.option("maxPartitionBytes", "1m").parquet(str(tmp_path / "one.parquet"))
    sizes = dealt(scan).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == n and max(r["count"] for r in sizes) < n / 2
    assert dealt(scan).rdd.getNumPartitions() >= os.path.getsize(tmp_path / "one.parquet") / SHARE


def test_refresh_reads_its_feed_once(spark, tmp_path, monkeypatch):
    """A refresh parses the feed once, whatever it then counts and stores."""
    from cinderflow.plans.api import Service

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    raw = T.raw_rows(spark, DATA).drop("event_id").limit(200)
    said = Service(spark, str(tmp_path / "s")).refresh([(raw.withColumn("frp", counted("frp")), "live", "fetched")], "2024-02-01", "now").first()
    assert said.status == "success" and said.ingested > 100
    assert seen.value <= 200


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    from cinderflow.operators.store import Store

    store = Store(spark, str(tmp_path / "s"), buckets=1)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        store.commit({"t": "id"}, wholes={"t": spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))})
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    rows = store.read("t")
    assert len(rows.inputFiles()) > 1 and rows.count() == rows.distinct().count() == 200_000


def test_cells_beyond_the_date_line_are_as_few_as_elsewhere(spark):
    """Copies of a table have sites further and further east. What lies beyond 180 meets what it lies next to, by a handful of cells."""
    from cinderflow.functions import geo
    from cinderflow.operators import spatial

    points = spark.createDataFrame([(1, 30.0, -119.0), (2, 30.0, 179.999), (3, 30.0, 240.0), (4, 30.0, 240.001), (5, 30.0, -179.999), (6, 30.0, 5000.0), (7, 30.0, 5000.001)], "id long, latitude double, longitude double")
    bands = points.select("longitude", F.size(geo.lon_cells_around(geo.lat_cell(F.col("latitude"), 1500.0), F.col("latitude"), F.col("longitude"), 1500.0)).alias("n"))
    assert all(r.n <= 6 for r in bands.collect())
    pairs = spatial.within(points, spatial.as_right(points, "id"), 1500.0, F.col("id") < F.col("r_id")).select("id", "r_id")
    assert sorted(map(tuple, pairs.collect())) == [(2, 5), (3, 4), (6, 7)]


def test_incidents_of_a_crowded_place_keep_few_edges(spark):
    """Of those around a detection that are all proximate to each other it keeps two, however many there are."""
    from cinderflow.operators import incidents

    rows = [(f"d{i:03d}", 34.0 + i % 7 * 1e-4, -118.0, "2026-10-01", f"{i % 24:02d}00", "wildfire", "C" if i % 3 else None, i * 37 % 101 / 1.0, "high", 5.0, False) for i in range(120)]
    spots = spark.createDataFrame(rows, "id string, latitude double, longitude double, acq_date string, acq_time string, source_type string, cluster_id string, risk_score double, risk_level string, frp double, is_anomaly boolean").withColumn("last_updated", F.lit(None).cast("string"))
    ranks, tops = incidents.grouped(spots)
    assert incidents.edges(spots).count() == 120 * 119 / 2
    kept = {(r.above, r.below) for r in incidents.descents(spots, ranks).collect()}
    assert len(kept) < 6 * 120 and all(a < b for a, b in kept) and {r.top for r in tops.collect()} == {1}
