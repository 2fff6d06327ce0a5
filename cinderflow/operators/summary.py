"""Key figures and the breakdown by source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LEVELS, SOURCES
from ..functions.common import cents_mean, half_up
from ..functions.scores import tier


def kpis(rows: DataFrame) -> DataFrame:
    """One row: totals, tiers, averages and the dominant source (of equal counts the greater name)."""
    t = tier(F.col("risk_level"), F.col("risk_score"))
    parts = rows.withColumn("__tier", t).groupBy("source_type").agg(
        F.count("*").alias("n"),
        *(F.count_if(F.col("__tier") == k).alias(k) for k in LEVELS),
        F.sum(F.floor(F.col("frp") * 100 + 0.5).cast("long")).alias("frp"),
        F.max("frp").alias("max_frp"),
        F.sum(F.floor(F.col("risk_score") * 10 + 0.5).cast("long")).alias("risk"),
        F.count_if("is_anomaly").alias("anomalies"),
    )
    zero = lambda x, v=0: F.coalesce(x, F.lit(v))
    return parts.agg(
        zero(F.sum("n")).alias("total"),
        *(zero(F.sum(k)).alias(f"n_{k}") for k in LEVELS),
        zero(F.sum("anomalies")).alias("n_anomalies"),
        zero(half_up(F.sum("frp") / F.sum("n") / 100.0, 2), 0.0).alias("avg_frp"),
        F.greatest(F.lit(0.0), zero(half_up(F.max("max_frp"), 2), 0.0)).alias("max_frp"),
        zero(half_up(F.sum("risk") / F.sum("n") / 10.0, 1), 0.0).alias("avg_risk"),
        zero(F.max_by("source_type", F.struct("n", "source_type")), "unknown").alias("dominant_source"),
        F.map_from_entries(F.collect_list(F.struct("source_type", "n"))).alias("source_counts"),
    )


def source_breakdown(rows: DataFrame) -> DataFrame:
    """Each source's count, share, averages, label and driver, the most frequent first."""
    labels = F.create_map(*[F.lit(x) for k, (label, _) in SOURCES.items() for x in (k, label)])
    drivers = F.create_map(*[F.lit(x) for k, (_, driver) in SOURCES.items() for x in (k, driver)])
    found = rows.groupBy("source_type").agg(F.count("*").alias("n"), cents_mean(F.col("frp"), 2).alias("avg_frp"), half_up(F.sum(F.floor(F.col("risk_score") * 10 + 0.5).cast("long")) / F.count("*") / 10.0, 1).alias("avg_risk"))
    total = found.agg(F.sum("n").alias("total"))  # found has a row for each source type, so this is small
    shared = found.join(F.broadcast(total))
    return shared.select("source_type", "n", half_up(100.0 * F.col("n") / F.col("total"), 1).alias("pct"), "avg_frp", "avg_risk", F.try_element_at(labels, "source_type").alias("label"), F.try_element_at(drivers, "source_type").alias("driver")).orderBy(F.desc("n"), F.desc("avg_risk"), "source_type")


def top_critical(rows: DataFrame, n: int = 5) -> DataFrame:
    """The n gravest critical or high hotspots: a top-k plan."""
    t = tier(F.col("risk_level"), F.col("risk_score"))
    return rows.withColumn("tier", t).where(F.col("tier").isin("critical", "high")).orderBy(F.desc("risk_score"), F.desc("frp"), "id").limit(n)


def chart_sources(rows: DataFrame) -> DataFrame:
    """Bars of the sources chart: the label before its slash, the count and the mean frp in whole megawatts."""
    return source_breakdown(rows).select("source_type", F.trim(F.substring_index("label", "/", 1)).alias("name"), "n", F.floor(F.col("avg_frp") + 0.5).cast("long").alias("avg_frp"))


def chart_peaks(rows: DataFrame, n: int = 6) -> DataFrame:
    """Bars of the peaks chart, the n greatest by frp, then id: the id behind its first hyphen, the place before its first comma."""
    tail = F.when(F.contains("id", F.lit("-")), F.expr("substring(id, locate('-', id) + 1)")).otherwise("")
    place = F.coalesce(F.nullif(F.substring_index("nearest_place", ",", 1), F.lit("")), F.lit("Unknown"))
    return rows.orderBy(F.desc("frp"), "id").limit(n).select(tail.alias("tail"), "frp", F.col("risk_score").alias("risk"), place.alias("place"))
