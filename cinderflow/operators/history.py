"""Recurrence of detections at a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Recurrence
from ..functions.common import half_up
from ..plans.lineage import shuffled, staged
from .spatial import PLACE, as_right, within


def place_days(dated: DataFrame) -> DataFrame:
    """(latitude, longitude, day, n, cents, several) of each place and day with detections: how many, the sum of their frp in hundredths,
    and whether more than one id was seen."""
    cents = F.floor(F.col("frp") * 100 + 0.5).cast("long")
    return dated.where("day is not null").groupBy(*PLACE, "day").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"), (F.min("id") != F.max("id")).alias("several"))


def first_days(days: DataFrame, radius_m: float) -> DataFrame:
    """(latitude, longitude, own, own_several, others): of each place in `place_days` its first day, whether more than one id was seen on that
    day, and the first day of all other places within `radius_m`. Places meet here, not detections: a place that burns for years is one
    row, whatever its age."""
    number = F.unix_date("day").cast("long") * 2 + F.col("several").cast("long")  # orders by day; a long, whose minimum needs no sorting
    places = days.groupBy(*PLACE).agg(F.min(number).alias("first")).select(*PLACE, F.date_from_unix_date(F.floor(F.col("first") / 2).cast("int")).alias("own"), (F.col("first") % 2 != 0).alias("own_several"))
    elsewhere = (F.col("latitude") != F.col("r_latitude")) | (F.col("longitude") != F.col("r_longitude"))
    near = within(places, as_right(places, "own"), radius_m, elsewhere)
    return places.join(shuffled(near.groupBy(*PLACE).agg(F.min("r_own").alias("others"))), PLACE, "left")


def recurrence(rows: DataFrame, config: Recurrence = Recurrence()) -> DataFrame:
    """For every hotspot the earlier detections within `radius_m`: counts over the short and the long window, recurrence
    flag, frequency and persistence scores, first date and pattern. Rows without a valid date have no history.

    Detections are first counted by place and day, so that a place with any share of all rows is one row a day, in a table that is written once. These meet in a join on
    cell and stretch of days, in which none older than the long window meets another; a detection then takes itself off the sums of its own place
    and day. The first date, which has no window, comes from the places (`first_days`). Ids are taken to be those of single detections.
    """
    cents = F.floor(F.col("frp") * 100 + 0.5).cast("long")
    dated = rows.select("id", *PLACE, "frp", F.substring("acq_date", 1, 10).try_cast("date").alias("day"))
    days = staged(place_days(dated).withColumn("place_day", F.monotonically_increasing_id()), "place-days")
    stretch = F.floor(F.unix_date("day") / (config.long_days + 1)).cast("long")  # a day counts for this stretch of days and the next
    earlier = as_right(days, "day", "n", "cents")
    earlier = earlier.withColumn("__days", F.explode(F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.floor(F.unix_date("r_day") / (config.long_days + 1)).cast("long") + k)))
    age = F.datediff("day", "r_day")
    recent = (F.col("r_day") <= F.col("day")) & (age <= config.long_days)
    near = within(days.select(*PLACE, "day", "place_day").withColumn("__days", stretch), earlier, config.radius_m, recent, on=("__days",))
    short = age <= config.short_days
    itself = (F.col("latitude") == F.col("r_latitude")) & (F.col("longitude") == F.col("r_longitude")) & (age == 0)
    seen = ~itself | (F.col("r_n") > 1)  # on this day and at this place by another than the detection itself
    # the days of the short window as bits, where they fit
    bits = F.bit_count(F.bit_or(F.when(short & seen, F.expr("shiftleft(1L, datediff(day, r_day))")))).cast("long") if config.short_days <= 62 else F.count_distinct(F.when(short & seen, F.col("r_day")))
    sums = near.groupBy("place_day").agg(
        F.sum(F.when(short, F.col("r_n"))).alias("all30"),
        F.sum("r_n").alias("all90"),
        bits.alias("seen30"),
        F.max(F.when(seen, F.col("r_day"))).alias("last_day"),
        F.sum(F.when(short, F.col("r_cents"))).alias("cents30"),
    )
    own = F.when((F.col("own") < F.col("day")) | ((F.col("own") == F.col("day")) & F.col("own_several")), F.col("own"))
    first = F.least(own, F.when(F.col("others") <= F.col("day"), F.col("others")))
    known = days.join(shuffled(first_days(days, config.radius_m)), PLACE, "left").select("place_day", *PLACE, "day", first.alias("first_day")).join(shuffled(sums), "place_day", "left")
    less = lambda c, x: F.greatest(F.coalesce(F.col(c) - x, F.lit(0)), F.lit(0))
    found = dated.join(shuffled(known), [*PLACE, "day"], "left").select("id", "frp", "first_day", "last_day", less("all30", 1).alias("n30"), less("all90", 1).alias("n90"), F.coalesce("seen30", F.lit(0)).alias("days30"), (F.col("cents30") - F.coalesce(cents, F.lit(0))).alias("cents30"))
    found = found.withColumn("mean30", F.when(F.col("n30") > 0, F.col("cents30") / F.col("n30") / 100.0))
    n30, n90 = F.col("n30"), F.col("n90")
    mean, span = F.coalesce("mean30", F.lit(0.0)), F.datediff("last_day", "first_day")
    pattern = (
        F.when((n30 >= 8) & (mean < 45), "known_industrial_stack")
        .when((n30 >= 3) & (span <= 5) & ((mean >= 45) | (F.col("frp") >= 50)), "persistent_burn")
        .when((n30 >= 3) & mean.between(10, 60), "agricultural_clearing")
        .when(n30 >= 2, "persistent_burn")
        .otherwise("none")
    )
    return found.select(
        "id",
        n30.alias("prior_30d"),
        n90.alias("prior_90d"),
        ((n30 >= 3) | (n90 >= 6)).alias("is_recurrent"),
        (n30 >= 1).alias("is_repeated"),
        F.least(F.lit(1.0), half_up(n30 * 0.05 + F.greatest(n90 - n30, F.lit(0)) * 0.015, 2)).alias("frequency"),
        F.least(F.lit(1.0), half_up(F.col("days30") / 7.0, 2)).alias("persistence"),
        F.date_format("first_day", "yyyy-MM-dd").alias("first_date"),
        pattern.alias("pattern"),
    )
