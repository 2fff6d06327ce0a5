"""What a client asks for, as functions over a store of snapshots: each gives DataFrames, nothing is collected but one-row answers."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts, dossier, store, summary
from ..operators.filters import HotspotFilter, page
from ..sources import ingest
from .lineage import staged


KEYS = {"hotspots": "id", "alerts": "id", "details": "id", "meta": "key"}


class Service:
    """Tables hotspots, alerts, details and meta in one store."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.store = spark, store.Store(spark, folder)

    def _table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def _has(self, name: str) -> bool:
        return self.store.has(name)

    def seed(self, tables: dict[str, DataFrame]) -> bool:
        """Loads whole tables in one commit where there are no hotspots yet; whether it did."""
        if self._has("hotspots") and not self._table("hotspots").isEmpty():
            return False
        self.store.commit(KEYS, wholes=tables)
        return True

    def hotspots(self, filters: HotspotFilter = HotspotFilter(), number: int = 1, size: int = 50) -> tuple[DataFrame, DataFrame]:
        """A page, and one row with the number of all matches and the data mode."""
        rows = filters.apply(self._table("hotspots"))
        return page(rows, number, size), rows.agg(F.count("*").alias("total"), F.max("data_mode").alias("data_mode"))

    def detail(self, hotspot: str) -> DataFrame:
        """The dossier of one hotspot; no rows if it isn't known."""
        rows = self._table("hotspots").where(F.col("id") == hotspot)
        details = self._table("details") if self._has("details") else self.spark.createDataFrame([], "id string")
        return dossier.dossiers(rows, details)

    def summary(self) -> DataFrame:
        return summary.kpis(self._table("hotspots")).join(F.broadcast(alerts.unread(self.kept_alerts())))  # one row each

    def sources(self) -> DataFrame:
        return summary.source_breakdown(self._table("hotspots"))

    def kept_alerts(self) -> DataFrame:
        if not self._has("alerts"):
            return alerts.from_hotspots(self._table("hotspots"))
        return alerts.deduplicated(self._table("alerts"), "seq")

    def alerts(self, severity: str | None = None, unread_only: bool = False) -> tuple[DataFrame, DataFrame]:
        """The feed, and one row with the number of unread alerts before filters."""
        kept = self.kept_alerts()
        return alerts.feed(kept, severity, unread_only), alerts.unread(kept)

    def acknowledge(self, alert: str) -> bool:
        """Rewrites the bucket of that alert alone."""
        mine = self._table("alerts").where(F.col("id") == alert)
        if mine.isEmpty():
            return False
        self.store.commit(KEYS, {"alerts": alerts.acknowledged(mine, alert).withColumn("batch_seq", F.lit(0))})
        return True

    def generate_alerts(self) -> int:
        """Makes the alerts of all hotspots, folds those of one event, and writes them; how many."""
        made = alerts.from_hotspots(self._table("hotspots")).withColumn("seq", F.lit(0).cast("long"))
        self.store.commit(KEYS, wholes={"alerts": alerts.deduplicated(made, "seq")})
        return self._table("alerts").count()

    def refresh(self, raw_sources: list[tuple[DataFrame | None, str, str]], run_date: str, now: str) -> DataFrame:
        """Takes the first source that has rows (live, cache, demo), normalizes, upserts and notes the sync, in one commit. One row:
        status, message, ingested, seconds. The same feed twice leaves the same rows. If anything fails on the way, the last source, the
        sample, is loaded instead; if that fails too, the store is as it was and the status is error."""
        began = time.perf_counter()
        try:
            mode, message, ingested = self._sync(raw_sources, run_date, now)
        except Exception as problem:  # whatever a feed has in store for us
            try:
                mode, message, ingested = self._sync(raw_sources[-1:], run_date, now)
                mode, message = "demo", f"sample reloaded after {type(problem).__name__}"
            except Exception as second:
                mode, message, ingested = "error", f"{type(problem).__name__}, then {type(second).__name__}", 0
        status = {"live": "success", "none": "empty", "error": "error"}.get(mode, "fallback_sample")
        return self.spark.createDataFrame([(status, message, ingested, round(time.perf_counter() - began, 3))], "status string, message string, ingested long, seconds double")

    def _sync(self, raw_sources: list[tuple[DataFrame | None, str, str]], run_date: str, now: str) -> tuple[str, str, int]:
        raw, mode, message = ingest.fallback(raw_sources)
        if raw is None:
            return mode, message, 0
        # read and parsed once, then counted and stored from there
        new = staged(ingest.normalized(raw.withColumn("batch_seq", F.monotonically_increasing_id()), run_date, keep=("data_mode", "batch_seq")), "refresh")
        ingested = new.select("id").distinct().count()
        meta = self.spark.createDataFrame([("data_mode", mode, 1), ("last_sync", now, 1)], "key string, value string, batch_seq long")
        self.store.commit(KEYS, {"hotspots": new, "meta": meta})
        return mode, message, ingested

    def clear(self) -> int:
        """Empties the hotspots; the number that there were."""
        rows = self._table("hotspots")
        n = rows.count()
        self.store.commit(KEYS, wholes={"hotspots": store.emptied(rows)})
        return n

    def health(self) -> DataFrame:
        """status, data mode (demo unless the last sync was live) and last sync in one row."""
        if not self._has("meta"):
            return self.spark.createDataFrame([("ok", "demo", None)], "status string, data_mode string, last_sync string")
        value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
        mode = F.when(value("data_mode") == "live", "live").otherwise("demo")
        return self._table("meta").agg(F.lit("ok").alias("status"), mode.alias("data_mode"), value("last_sync").alias("last_sync"))

    def orphaned_alerts(self) -> DataFrame:
        """Alerts whose hotspot isn't there."""
        return alerts.orphans(self._table("alerts"), self._table("hotspots"))
