"""From raw detection rows, all text, to hotspots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SATELLITES, SOURCES
from ..functions.common import number
from ..functions.geo import valid_point
from ..functions.scores import baseline_risk
from ..plans.lineage import staged

ALIASES = {
    "latitude": ("latitude", "lat"),
    "longitude": ("longitude", "lon"),
    "brightness": ("bright_ti4", "brightness", "bright_k"),
    "bright_t31": ("bright_t31", "bright_ti5"),
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a landing folder's CSV files, every column as text. No schema inference: one pass over the data."""
    return spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)


def looks_like_error(spark: SparkSession, path: str) -> bool:
    """Whether the first line is an error page or message instead of a header."""
    first = spark.read.text(path).limit(1).collect()
    return not first or any(w in first[0].value.lower() for w in ("error", "invalid", "html"))


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records of JSON files as text columns: an array a file, which is one task, or a record a `lines`, which is split like any text."""
    rows = spark.read.option("multiLine", not lines).option("primitivesAsString", True).json(path)
    return rows.drop("_corrupt_record")


def landed_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """`read_csv`, or None for a landing that begins with an error page, so that a chain of sources goes on to the next."""
    return None if looks_like_error(spark, path) else read_csv(spark, path)


def _first(raw: DataFrame, *names: str) -> Column:
    """The first of the columns that is there and not blank; header case doesn't matter."""
    known = {c.lower(): c for c in raw.columns}
    found = [F.nullif(F.trim(F.col(f"`{known[n]}`").cast("string")), F.lit("")) for n in names if n in known]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def satellite(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SATELLITES.items() for x in pair])
    clean = F.trim(code)
    return F.when(F.coalesce(clean, F.lit("")) == "", "Suomi-NPP").otherwise(F.coalesce(F.try_element_at(names, F.upper(clean)), clean))


def confidence(raw: Column) -> Column:
    text = F.lower(F.trim(raw))
    value = number(text)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "nominal")
        .when(text.isin("l", "low"), "low")
        .when(text.isin("n", "nominal", "med", "medium"), "nominal")
        .when(text.isin("h", "high"), "high")
        .when(value >= 80, "high")
        .when(value >= 30, "nominal")
        .when(value.isNotNull(), "low")
        .otherwise(text)
    )


def acq_time(raw: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9]", "")
    return F.when(digits == "", "0000").otherwise(F.substring(F.lpad(digits, 4, "0"), 1, 4))


def daynight(raw: Column, time: Column) -> Column:
    text = F.upper(F.trim(raw))
    hour = F.substring(time, 1, 2).try_cast("int")
    return F.when(text.isin("D", "DAY"), "D").when(text.isin("N", "NIGHT"), "N").when(hour.between(6, 18), "D").otherwise("N")


def digest_id(instrument: Column, satellite_name: Column, date: Column, lat: Column, lon: Column, time: Column) -> Column:
    """An id that depends on nothing but the detection itself, so feeds can be read in any order and again."""
    mark = F.upper(F.substring(F.md5(F.format_string("%.4f_%.4f_%s", lat, lon, time)), 1, 6))
    return F.concat_ws("-", instrument, _short(satellite_name), F.replace(date, F.lit("-"), F.lit("")), mark)


def sequence_id(instrument: Column, satellite_name: Column, date: Column, sequence: Column) -> Column:
    return F.concat_ws("-", instrument, _short(satellite_name), F.replace(date, F.lit("-"), F.lit("")), F.format_string("%04d", sequence))


def _short(satellite_name: Column) -> Column:
    return F.replace(F.upper(satellite_name), F.lit("-"), F.lit(""))


def parsed(raw: DataFrame, run_date: str, keep: tuple[str, ...] = (), sequence: str | None = None) -> DataFrame:
    """Typed columns, `rejected` (the reason, or null) and the columns of `keep`, for every raw row.

    run_date stands in for a blank date. A numeric zero is a value, not a gap.
    """
    read = {
        "lat": number(_first(raw, *ALIASES["latitude"])),
        "lon": number(_first(raw, *ALIASES["longitude"])),
        "bright": number(_first(raw, *ALIASES["brightness"])),
        "power": F.greatest(F.coalesce(number(_first(raw, "frp")), F.lit(0.0)), F.lit(0.0)),
        "name": satellite(_first(raw, "satellite")),
        "time": acq_time(_first(raw, "acq_time")),
        "date": F.coalesce(_first(raw, "acq_date"), F.lit(run_date)),
        "given_score": number(_first(raw, "risk_score")),
        "given_level": F.lower(_first(raw, "risk_level")),
        "given_anomaly": F.lower(_first(raw, "is_anomaly")),
        "source": F.lower(_first(raw, "source_type")),
        "own_id": _first(raw, "id"),
        "own_instrument": _first(raw, "instrument"),
        "scan": F.coalesce(number(_first(raw, "scan")), F.lit(0.375)),
        "track": F.coalesce(number(_first(raw, "track")), F.lit(0.375)),
        "confidence": confidence(_first(raw, "confidence")),
        "version": F.coalesce(_first(raw, "version"), F.lit("2.0NRT")),
        "t31": number(_first(raw, *ALIASES["bright_t31"])),
        "own_daynight": _first(raw, "daynight"),
        "cluster_id": _first(raw, "cluster_id"),
        "cluster_size": F.coalesce(_first(raw, "cluster_size").try_cast("int"), F.lit(1)),
        "place": _first(raw, "nearest_place"),
        "updated": _first(raw, "last_updated"),
    }
    more = (sequence,) if sequence and sequence not in keep else ()
    # a generator of one row: a filter on what is parsed isn't pushed below it, where every row would be parsed again
    typed = raw.select(*(F.col(c) for c in keep + more), F.inline(F.array(F.struct(*(v.alias(f"__{k}") for k, v in read.items())))))
    lat, lon, bright, frp, name, time, date, given_score, given_level, source = (F.col(f"__{k}") for k in ("lat", "lon", "bright", "power", "name", "time", "date", "given_score", "given_level", "source"))
    instrument = F.coalesce("__own_instrument", F.when(name.isin("Terra", "Aqua"), "MODIS").otherwise("VIIRS"))
    score, level, anomaly = baseline_risk(frp, bright)
    given = given_score.isNotNull() & given_level.isNotNull()
    made = sequence_id(instrument, name, date, F.col(sequence)) if sequence else digest_id(instrument, name, date, lat, lon, time)
    reason = (
        F.when(lat.isNull() | lon.isNull() | bright.isNull(), "missing")
        .when(~valid_point(lat, lon), "out of range")
        .when((bright <= 0) | (bright > 1000), "brightness")
    )
    return typed.select(
        *(F.col(c) for c in keep),
        F.coalesce(F.col("__own_id"), made).alias("id"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        bright.alias("brightness"),
        F.col("__scan").alias("scan"),
        F.col("__track").alias("track"),
        date.alias("acq_date"),
        time.alias("acq_time"),
        name.alias("satellite"),
        instrument.alias("instrument"),
        F.col("__confidence").alias("confidence"),
        F.col("__version").alias("version"),
        F.col("__t31").alias("bright_t31"),
        frp.alias("frp"),
        daynight(F.col("__own_daynight"), time).alias("daynight"),
        F.when(source.isin(*SOURCES), source).otherwise("unknown").alias("source_type"),
        F.when(given, given_score).otherwise(score).alias("risk_score"),
        F.when(given, F.when(given_level.isin("low", "medium", "high", "critical"), given_level).otherwise("medium")).otherwise(level).alias("risk_level"),
        F.when(given, F.col("__given_anomaly").isin("true", "1", "yes", "t")).otherwise(anomaly).alias("is_anomaly"),
        F.col("__cluster_id").alias("cluster_id"),
        F.col("__cluster_size").alias("cluster_size"),
        F.col("__place").alias("nearest_place"),
        F.col("__updated").alias("last_updated"),
        reason.alias("rejected"),
    )


def normalized(raw: DataFrame, run_date: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return parsed(raw, run_date, keep).where("rejected is null").drop("rejected")


def first_by_id(rows: DataFrame, order: str) -> DataFrame:
    """Of rows with one id the first in `order`, by an aggregate with partial results."""
    return _pick(rows, F.min_by, order)


def last_by_id(rows: DataFrame, order: str) -> DataFrame:
    return _pick(rows, F.max_by, order)


def _pick(rows: DataFrame, which, order: str) -> DataFrame:
    others = [c for c in rows.columns if c != "id"]
    picked = rows.groupBy("id").agg(which(F.struct(*others), F.col(order)).alias("row"))
    return picked.select("id", "row.*").select(*rows.columns)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`sequence` from 1 in a declared order, contiguous. Rows are sorted and staged once, and counted by range partition, so no
    single task sorts all and both uses see the same ranges."""
    sorted_rows = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    counts = sorted_rows.groupBy("__part").count()
    before = counts.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = (F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33)).alias("inside")
    return sorted_rows.join(F.broadcast(before), "__part").select(*rows.columns, (F.col("__before") + inside + 1).alias("sequence"))  # `before` has a row for each partition


def fallback(candidates: list[tuple[DataFrame | None, str, str]]) -> tuple[DataFrame | None, str, str]:
    """The first source that has rows, with its mode and message: live, then cache, then demo. Rows from a cache were live once
    and keep that mode."""
    for rows, mode, message in candidates:
        if rows is not None and not rows.isEmpty():
            mode = "live" if mode == "cache" else mode
            return rows.withColumn("data_mode", F.lit(mode)), mode, message
    return None, "none", "no source has rows"


def area_filter(rows: DataFrame, *, south: float | None = None, north: float | None = None, west: float | None = None, east: float | None = None, since: str | None = None) -> DataFrame:
    """The request's box and first date as predicates, which reach a Parquet scan."""
    tests = [F.col(c) >= v for c, v in (("latitude", south), ("longitude", west), ("acq_date", since)) if v is not None]
    tests += [F.col(c) <= v for c, v in (("latitude", north), ("longitude", east)) if v is not None]
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows
