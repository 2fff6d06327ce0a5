"""Detections as a stream: normalized rows, upserts by micro-batch, counts by time window.

Late rows: events up to `LATENESS` behind the newest still count; later ones are dropped by the watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.store import Store
from ..plans.lineage import work_path
from ..sources.ingest import normalized

LATENESS = "2 days"


def read_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def first_seen(rows: DataFrame, time: str = "event_time") -> DataFrame:
    """The first row of each id within the watermark; the state of older ids is let go."""
    return rows.withWatermark(time, LATENESS).dropDuplicatesWithinWatermark(["id"])


def window_counts(rows: DataFrame, time: str, width: str, *keys: str) -> DataFrame:
    """Count and sum of hundredths of frp by tumbling window and keys."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, LATENESS)
    sums = timed.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("cents"))
    return sums.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), *keys, "n", "cents")


def sessions(rows: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    """Sessions by keys: rows less than `gap` apart. A session comes out once the watermark has passed its end, and then doesn't
    change; a row that is late by the watermark of the batch before is dropped, one that comes in time may join two sessions."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull()).withWatermark(time, LATENESS)
    sums = timed.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("cents"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return sums.select(stamp("w.start").alias("session_start"), stamp("w.end").alias("session_end"), *keys, "n", "cents")


def appended(rows: DataFrame) -> DataFrame:
    """Runs a query of final rows (append mode) over all that is there now and returns them."""
    return _run(rows, "append")


def latest(updates: DataFrame, *keys: str) -> DataFrame:
    """Runs a query of updates over all that is there now and returns the last one of each key."""
    rows = _run(updates, "update")
    others = [c for c in updates.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, "last.*")


def _run(rows: DataFrame, mode: str) -> DataFrame:
    spark = rows.sparkSession
    path = work_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/{number}")  # a batch that is run again replaces itself

    done = rows.writeStream.outputMode(mode).foreachBatch(write).queryName(f"w{uuid.uuid4().hex}").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    out = spark.read.schema(rows.schema.add("batch", "long")).parquet(f"{path}/rows/*")
    return out if mode == "update" else out.drop("batch")


def upsert_each_batch(raw: DataFrame, path: str, run_date: str, checkpoint: str) -> StreamingQuery:
    """Keeps table hotspots of the store at `path` current, rewriting only the buckets that a batch touches. Of rows of one id in a batch the
    last read wins. A batch that is run again after a failure gives the same rows: the upsert depends on ids and on the order of the
    batch's files alone."""

    def write(batch: DataFrame, number: int) -> None:
        rows = normalized(batch.withColumn("batch_seq", F.monotonically_increasing_id()), run_date, keep=("batch_seq",))
        Store(batch.sparkSession, path).commit({"hotspots": "id"}, {"hotspots": rows})

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(counts: DataFrame, transform: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Runs a windowed count over all that is there now and returns the final rows: of each window the last update."""
    spark = counts.sparkSession
    path = work_path(spark, "stream")
    keys = [c for c in counts.columns if c not in ("n", "cents")]

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(f"{path}/rows")

    done = counts.writeStream.outputMode("update").foreachBatch(write).queryName(f"w{uuid.uuid4().hex}").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    return transform(rows.groupBy(*keys).agg(F.max_by(F.struct("n", "cents"), "batch").alias("last")).select(*keys, "last.n", "last.cents"))
