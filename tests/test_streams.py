"""Alert state, sessions and first rows as streams, against batch folds over any cut into micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cinderflow.operators import alerts
from cinderflow.streaming import alert_state, refresh

SCHEMA = "id string, hotspot_id string, severity string, risk_score double, is_acknowledged boolean, at timestamp, seq long"
BEGIN = datetime(2026, 10, 1)


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", alert_state.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def made(n, seed=1):
    rng = random.Random(seed)
    return [(f"A{k}", f"H{rng.randrange(6)}", rng.choice(["critical", "info"]), rng.choice([None, 10.0, 20.0, 20.0, 30.0]), rng.choice([True, False, False, False, None]), BEGIN + timedelta(minutes=10 * k), k) for k in range(n)]


def folded(rows):
    """(id, risk, acknowledged) by key: one pass in the order of time."""
    out = {}
    for i, hotspot, severity, risk, known, _, _ in sorted(rows, key=lambda r: r[5:]):
        key, new = (hotspot, severity), (i, float("-inf") if risk is None else risk, bool(known))
        now = out.get(key)
        if now is None or (new[2] and not now[2]):
            out[key] = new
        elif new[1] > now[1]:
            out[key] = (new[0], new[1], now[2])
    return {k: (i, None if r == float("-inf") else r, a) for k, (i, r, a) in out.items()}


def test_batch_dedup_equals_the_fold(spark):
    rows = made(600)
    for salts in (1, 5, 16):
        got = alerts.deduplicated(spark.createDataFrame(rows, SCHEMA), "at", salts).collect()
        assert {(r.hotspot_id, r.severity): (r.id, r.risk_score, r.is_acknowledged) for r in got} == folded(rows)
    plan = alerts.deduplicated(spark.createDataFrame(rows, SCHEMA), "at")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    assert alerts.deduplicated(spark.createDataFrame([], SCHEMA), "at").count() == 0
    unknown = [("A1", None, "info", 5.0, False, BEGIN, 1), ("A2", None, "info", 6.0, True, BEGIN, 2), ("A3", None, "info", 7.0, False, BEGIN, 3)]
    (r,) = alerts.deduplicated(spark.createDataFrame(unknown, SCHEMA), "seq").collect()
    assert (r.id, r.is_acknowledged) == ("A3", True)


def feed(spark, folder, batches):
    """Files in the order of their batches, one a trigger."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / f"{k:04d}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def last_updates(rows):
    """By key the last update that isn't the end of its state."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.batch, r.closed)):
        if not r.closed:
            out[r.hotspot_id, r.severity] = (r.id, r.risk_score, r.is_acknowledged)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_alert_state_equals_the_batch_fold(spark, tmp_path, seed):
    """Micro-batches of any size, rows out of order by less than the lateness allowed."""
    rng = random.Random(seed)
    rows = made(400, seed)
    arrival = sorted(rows, key=lambda r: r[5] + timedelta(minutes=rng.randrange(300)))
    cuts = [0, *sorted(rng.sample(range(1, 400), 4)), 400]
    stream = feed(spark, tmp_path / "in", [arrival[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    got = refresh._run(alert_state.alert_state(stream, lateness="6 hours"), "update").collect()
    assert last_updates(got) == folded(rows)


def test_alert_state_survives_a_restart_and_drops_late_rows(spark, tmp_path):
    rows = made(300, 3)
    seen = []

    def run(stream):
        done = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        done.foreachBatch(lambda batch, number: seen.extend(r.asDict() | {"batch": number} for r in batch.collect())).start().awaitTermination()

    stream = feed(spark, tmp_path / "in", [rows[:100], rows[100:200]])
    run(alert_state.alert_state(stream, lateness="1 hour"))
    spark.createDataFrame(rows[200:], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / "0002"))
    late = [("late", "H0", "critical", 99.0, True, BEGIN, -1)]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / "0003"))
    run(alert_state.alert_state(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), lateness="1 hour"))
    out = {}
    for r in sorted(seen, key=lambda r: r["batch"]):
        out[r["hotspot_id"], r["severity"]] = (r["id"], r["risk_score"], r["is_acknowledged"])
    assert out == folded(rows)


def test_alert_state_ends_by_timer(spark, tmp_path):
    at = lambda hours: BEGIN + timedelta(hours=hours)
    batches = [[("A1", "H1", "info", 5.0, False, at(0), 1), ("A2", "H1", "info", 9.0, True, at(1), 2)], [("B1", "H2", "info", 1.0, False, at(30), 3)], [("B2", "H2", "info", 2.0, False, at(60), 4)]]
    stream = feed(spark, tmp_path / "in", batches)
    got = refresh._run(alert_state.alert_state(stream, lateness="1 hour", idle_ms=12 * 3600 * 1000), "update").collect()
    ended = [(r.hotspot_id, r.id, r.risk_score, r.is_acknowledged) for r in got if r.closed]
    assert ("H1", "A2", 9.0, True) in ended and sum(r[0] == "H1" for r in ended) == 1


def test_sessions_join_and_late_rows_go(spark, tmp_path):
    at = lambda hours: BEGIN + timedelta(hours=hours)
    rows = [[(1, at(0), 1.0), (1, at(7), 1.0)], [(1, at(4), 1.0)], [(2, at(400), 5.0)], [(3, at(402), 1.0)], [(1, at(3), 9.0)], [(2, at(900), 1.0)]]
    for k, part in enumerate(rows):  # 4 h joins 0 h and 7 h; 3 h comes after the watermark of a whole batch has passed
        spark.createDataFrame(part, "user_id long, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:04d}"))
    stream = spark.readStream.schema("user_id long, ts timestamp, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, refresh.appended(refresh.sessions(stream, "ts", "6 hours", "user_id")).collect()))
    stamp = lambda h: at(h).strftime("%Y-%m-%d %H:%M:%S")
    assert got == [(stamp(0), stamp(13), 1, 3, 300), (stamp(400), stamp(406), 2, 1, 500), (stamp(402), stamp(408), 3, 1, 100)]


def test_first_seen_within_the_watermark(spark, tmp_path):
    at = lambda hours: BEGIN + timedelta(hours=hours)
    for k, part in enumerate([[("a", at(0))], [("a", at(1)), ("b", at(2))], [("c", at(200))], [("d", at(201))], [("a", at(202))]]):
        spark.createDataFrame(part, "id string, event_time timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:04d}"))
    stream = spark.readStream.schema("id string, event_time timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, refresh.appended(refresh.first_seen(stream)).select("id", F.col("event_time")).collect()))
    assert got == [("a", at(0)), ("a", at(202)), ("b", at(2)), ("c", at(200)), ("d", at(201))]


def test_held_alerts_are_few_and_fold_alike():
    """What is kept of held alerts gives the same fold whatever arrives later, and is a small part of them."""
    import random

    import pandas as pd

    from cinderflow.streaming.alert_state import FIELDS, folded, needed

    rng = random.Random(5)
    row = lambda k, ack: (f"a{k}", rng.choice([float("-inf"), 1.0, 2.0, 3.0, rng.random() * 50]), rng.random() < ack, rng.randint(0, 5000), k)
    order = lambda a: (a[3], a[4], a[0])
    for ack in (0.0, 0.01, 0.2):
        for _ in range(60):
            held, later = [row(k, ack) for k in range(rng.randint(1, 200))], [row(k, ack) for k in range(1000, 1000 + rng.randint(0, 5))]
            few = list(needed(pd.DataFrame(held, columns=FIELDS)).itertuples(index=False, name=None))
            settled = rng.choice([None, ("s", 2.0, rng.random() < 0.5, -1, -1)])
            assert folded(settled, sorted(few + later, key=order)) == folded(settled, sorted(held + later, key=order))
    many = [("a", rng.random(), k % 5 == 0, k, k) for k in range(20_000)]
    assert len(needed(pd.DataFrame(many, columns=FIELDS))) < 20
