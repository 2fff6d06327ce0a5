"""Weather payloads: JSON with a current block, or an hourly series as parallel arrays, to rows of the weather table.

Cases: a payload that isn't JSON, or lacks the block or its temperature, gives no rows; arrays may be of different lengths, what a shorter one
lacks is null, and so are values that aren't numbers; hours without time are dropped. Humidity is cut to 0..100, wind and rain to 0 at
least, the direction taken modulo 360; humidity 50, wind, direction and rain 0 stand in for what a current block lacks, nothing for gaps of a series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of a payload's measures, and of the columns here.
MEASURES = {
    "temperature_2m": "temperature", "relative_humidity_2m": "humidity", "wind_speed_10m": "wind", "wind_gusts_10m": "gust",
    "wind_direction_10m": "direction", "precipitation": "rain",
}
DEFAULTS = {"humidity": 50.0, "wind": 0.0, "direction": 0.0, "rain": 0.0}


def cleaned(rows: DataFrame) -> DataFrame:
    """Measures within their ranges."""
    least = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0)))
    return rows.withColumns({"humidity": F.when(F.col("humidity").isNotNull(), F.least(F.greatest("humidity", F.lit(0.0)), F.lit(100.0))), "wind": least("wind"), "rain": least("rain"), "direction": F.pmod("direction", F.lit(360.0))})


def _text_fields() -> str:
    return ", ".join(f"{m}: string" for m in MEASURES)


def current(payloads: DataFrame) -> DataFrame:
    """One row for each payload (column `payload`, beside others that are kept) with a current block."""
    block = F.from_json("payload", f"struct<current: struct<{_text_fields()}>>")["current"]
    value = lambda m, c: F.coalesce(block[m].try_cast("double"), F.lit(DEFAULTS.get(c)).cast("double"))
    kept = [c for c in payloads.columns if c != "payload"]
    return cleaned(payloads.select(*kept, *(value(m, c).alias(c) for m, c in MEASURES.items())).where("temperature is not null"))


def hourly(payloads: DataFrame) -> DataFrame:
    """One row for each hour of a payload's series: the other columns, at, and the measures."""
    arrays = ", ".join(f"{m}: array<string>" for m in ("time", *MEASURES))
    block = F.from_json("payload", f"struct<hourly: struct<{arrays}>>")["hourly"]
    kept = [c for c in payloads.columns if c != "payload"]
    parallel = payloads.select(*kept, block.alias("h")).where("h is not null")
    # a measure that is absent is an array without entries: arrays_zip would give null for the whole
    filled = [F.coalesce(F.col(f"h.{m}"), F.array().cast("array<string>")).alias(m) for m in ("time", *MEASURES)]
    rows = parallel.select(*kept, *filled).select(*kept, F.inline(F.arrays_zip("time", *MEASURES)))
    typed = rows.select(*kept, F.try_to_timestamp("time").alias("at"), *(F.col(m).try_cast("double").alias(c) for m, c in MEASURES.items()))
    return cleaned(typed.where("at is not null"))


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two `numbered` tables side by side by position: where one is shorter its columns are null. Positions are contiguous from 1, so
    this is an equi-join on them, which Spark deals out by hash: no table passes through one task."""
    return left.join(right, "sequence", "full")
