"""Clustering of detections into incidents.

Edges between proximate detections come from cell joins. The order-dependent greedy grouping is taken from them by staged
rounds of joins: a detection joins the first seed that reaches it along edges that lead down the ranks. What an earlier
group took doesn't stand in the way, for that group took all below it too. So no component or neighbour list is ever held
in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_M, INCOMPATIBLE, Incidents
from ..functions.common import half_up
from ..functions.scores import level_rank
from ..plans.lineage import shuffled, staged
from ..sources.ingest import numbered
from .graph import connected_components
from .spatial import as_right, within


def detection_time() -> Column:
    stamp = F.concat(F.col("acq_date"), F.lit(" "), F.substring("acq_time", 1, 2), F.lit(":"), F.substring("acq_time", 3, 2))
    return F.coalesce(F.try_to_timestamp("last_updated"), F.try_to_timestamp(stamp))


def incompatible(a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x | y, (((a == p) & (b == q)) | ((a == q) & (b == p)) for p, q in INCOMPATIBLE))


#: Cells of so many radii: a detection then goes to three of them, not nine.
CELLS = 3.0


def edges(hotspots: DataFrame, config: Incidents = Incidents()) -> DataFrame:
    """(a, b), a < b, of proximate detections: near in place and time, or of one given cluster within its envelope.

    Cells have three parts, band, cell and stretch of time as long as the window: a later detection looks for earlier ones into its own
    stretch and the one before. Those of one cluster, whatever their times, meet by cluster and cell instead."""
    c = F.col
    rows = hotspots.select("id", "latitude", "longitude", F.unix_timestamp(detection_time()).alias("at"), "source_type", "cluster_id")
    seconds = int(config.window_hours * 3600)
    timed = rows.where("at is not null").withColumn("__span", F.floor(c("at") / seconds))
    later = as_right(timed, "id", "at", "source_type").withColumn("__span", F.explode(F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.floor(c("r_at") / seconds) - k)))
    order = F.struct("at", "id") < F.struct(c("r_at").alias("at"), c("r_id").alias("id"))
    near = within(timed, later, config.distance_km * 1000, order & (c("r_at") - c("at") <= config.window_hours * 3600), on=("__span",), wide=CELLS)
    near = near.where(~(incompatible(c("source_type"), c("r_source_type")) & (c("distance_m") > config.incompatible_km * 1000)))
    envelope = max(2.5 * config.distance_km, config.envelope_km) * 1000
    tagged = rows.where("cluster_id is not null")
    same = within(tagged, as_right(tagged, "id", "cluster_id").withColumnRenamed("r_cluster_id", "cluster_id"), envelope, c("id") < c("r_id"), on=("cluster_id",), wide=CELLS)
    both = near.select("id", "r_id").unionByName(same.select("id", "r_id")).where("id <> r_id")
    return both.select(F.least("id", "r_id").alias("a"), F.greatest("id", "r_id").alias("b")).distinct()


def colours() -> dict[str, int]:
    """A colour for each source type that is incompatible with others; all of one colour are compatible, as are types that aren't listed with those of colour 0."""
    found: dict[str, int] = {}
    for kind in sorted({x for pair in INCOMPATIBLE for x in pair}):
        taken = {found.get(q if p == kind else p) for p, q in INCOMPATIBLE if kind in (p, q)}
        found[kind] = next(k for k in range(len(taken) + 1) if k not in taken)
    return found


def tile(km: Column | float) -> Column:
    """A number for the square, of the latitude and longitude, in which no two points are `km` apart; from one tile to the next parallel it is as wide as there."""
    high = F.degrees(F.lit(km) * 700 / EARTH_RADIUS_M)  # 0.7 of `km`, so that the diagonal is 0.99 of it
    band = F.floor(F.col("latitude") / high)
    widest = F.greatest(F.abs(F.cos(F.radians(band * high))), F.abs(F.cos(F.radians((band + 1) * high))))
    return F.shiftleft(band, 32) + F.floor(F.col("longitude") * widest / high)


def thinned(pairs: DataFrame, *group: str) -> DataFrame:
    """(above, below) of pairs (rank, r_rank) with the `group` of either end: of those of one group that are above a detection, the first and the last."""
    c = F.col
    up = c("rank") < c("r_rank")
    ends = pairs.where("rank <> r_rank").select(F.least("rank", "r_rank").alias("above"), F.greatest("rank", "r_rank").alias("below"), *(F.when(up, c(g)).otherwise(c(f"r_{g}")).alias(g) for g in group))
    kept = ends.groupBy("below", *group).agg(F.min("above").alias("first"), F.max("above").alias("last"))
    return kept.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("above"), "below")


def descents(hotspots: DataFrame, ranks: DataFrame, config: Incidents = Incidents()) -> DataFrame:
    """(above, below), above < below: as few of the `edges`, by the ranks (id, rank) of their ends, as lead from each rank down to the same ones.

    Detections of one tile, stretch of time and colour are all proximate to each other. So by rank each leads to the next, and the last of them above another
    detection leads to it from all the others. The first is kept as well: it saves rounds. What a detection keeps is thus bounded by the groups around it, however
    many detections these have. A given cluster within its envelope is one such group, whatever the times; a wider one is cut into tiles."""
    c = F.col
    seconds, kinds = int(config.window_hours * 3600), sorted({x for pair in INCOMPATIBLE for x in pair})
    coded = lambda of: reduce(lambda chain, k: chain.when(c("source_type") == k, of[k]), kinds, F.when(c("source_type").isNull(), None)).otherwise(0)
    rows = hotspots.select("id", "latitude", "longitude", F.unix_timestamp(detection_time()).alias("at"), coded({k: i + 1 for i, k in enumerate(kinds)}).alias("kind"), coded(colours()).alias("colour"), "cluster_id")
    rows = staged(rows.join(shuffled(ranks), "id").drop("id"), "incident-points")

    # an unknown type is compatible with what it lies next to alone, with others of unknown type too
    size = F.when(c("colour").isNull(), min(config.incompatible_km, config.distance_km)).otherwise(config.distance_km)
    timed = rows.where("at is not null").withColumn("__span", F.floor(c("at") / seconds))
    timed = timed.select("rank", "latitude", "longitude", "at", "kind", "__span", tile(size).alias("tile"), (c("__span") * 16 + F.coalesce("colour", F.lit(15))).alias("when"))
    later = as_right(timed, "rank", "at", "kind", "tile", "when").withColumn("__span", F.explode(F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.floor(c("r_at") / seconds) - k)))
    order = (c("at") < c("r_at")) | ((c("at") == c("r_at")) & (c("rank") < c("r_rank")))
    near = within(timed, later, config.distance_km * 1000, order & (c("r_at") - c("at") <= config.window_hours * 3600), on=("__span",), wide=CELLS)
    opposed = reduce(lambda x, y: x | y, (((c("kind") == p) & (c("r_kind") == q)) | ((c("kind") == q) & (c("r_kind") == p)) for p, q in ((kinds.index(p) + 1, kinds.index(q) + 1) for p, q in INCOMPATIBLE)))
    near = near.where(~(opposed & (c("distance_m") > config.incompatible_km * 1000)))

    envelope = max(2.5 * config.distance_km, config.envelope_km)
    tagged = rows.where("cluster_id is not null and abs(latitude) < double('inf') and abs(longitude) < double('inf')").select("rank", "latitude", "longitude", "cluster_id")
    span = lambda x: F.radians(F.max(x) - F.min(x))
    across = F.greatest(*(F.abs(F.cos(F.radians(f("latitude")))) for f in (F.min, F.max))) * span("longitude")
    boxes = tagged.groupBy("cluster_id").agg((F.sqrt(F.pow(span("latitude"), 2) + F.pow(across, 2)) <= 990 * envelope / EARTH_RADIUS_M).alias("whole"))
    tagged = tagged.join(shuffled(boxes), "cluster_id").withColumn("tile", F.when(~c("whole"), tile(envelope)))
    line = Window.partitionBy("cluster_id", "tile").orderBy("rank")
    chain = tagged.select(c("rank").alias("below"), F.first("rank").over(line).alias("first"), F.lag("rank").over(line).alias("last"))
    chain = chain.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("above"), "below").where("above < below")
    wide = tagged.where("not whole").select("rank", "latitude", "longitude", "cluster_id", "tile")
    same = within(wide, as_right(wide, "rank", "cluster_id", "tile").withColumnRenamed("r_cluster_id", "cluster_id"), envelope * 1000, (c("rank") < c("r_rank")) & (c("tile") != c("r_tile")), on=("cluster_id",), wide=CELLS)
    apart = thinned(same.withColumn("r_cluster_id", c("cluster_id")), "cluster_id", "tile")
    return thinned(near, "tile", "when").unionByName(chain).unionByName(apart)


#: Rounds of `first_seeds`; what a node knows reaches twice as far in each, so 40 do for chains of 2**40 detections.
ROUNDS = 40


def first_seeds(ranks: DataFrame, descents: DataFrame) -> DataFrame:
    """(rank, top) of each of the ranks: seeds are taken in the order of their ranks, and one pass over the later ones lets those join that are near any member so far.

    Seeds are those without a neighbour before them, and a detection's group is that of the first one from which edges
    lead down to it. Every round passes the first known along each edge, then takes over what that one knows.
    """
    c = F.col
    down = staged(descents.select("above", "below"), "incident-edges")  # all rounds are on longs
    least = lambda known: known.groupBy("rank").agg(F.min("top").alias("top"))
    own = ranks.select("rank", c("rank").alias("top"))
    now, seen = staged(least(own.unionByName(down.select(c("below").alias("rank"), c("above").alias("top")))), "incident-seeds"), None
    for _ in range(ROUNDS):
        known = now.select(c("rank").alias("at"), c("top").alias("further"))
        now = staged(now.join(shuffled(known), c("top") == c("at")).select("rank", c("further").alias("top")), "incident-seeds")
        passed = down.join(shuffled(now), c("above") == c("rank")).select(c("below").alias("rank"), "top")
        now = staged(least(now.unionByName(passed)), "incident-seeds")
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("rank", "top").cast("decimal(38,0)")).alias("h")).first()
        if new == seen:
            return now
        seen = new
    raise RuntimeError(f"groups not settled after {ROUNDS} rounds")


def components(hotspots: DataFrame, config: Incidents = Incidents()) -> DataFrame:
    """(id, component) of each detection with an edge: the least id in reach. The rounds are on the ranks of the ids."""
    c = F.col
    ranks = numbered(hotspots.select("id").where("id is not null").distinct(), ["id"]).select("id", c("sequence").alias("rank"))
    found = connected_components(descents(hotspots, ranks, config), "above", "below").select(c("id").alias("rank"), c("component").alias("least"))
    named = found.join(shuffled(ranks), "rank").select("id", "least")
    return named.join(shuffled(ranks.select(c("rank").alias("least"), c("id").alias("component"))), "least").select("id", "component")


def grouped(hotspots: DataFrame, config: Incidents = Incidents()) -> tuple[DataFrame, DataFrame]:
    """(id, rank) and (rank, top) of every id: its rank by gravity and that of the first of its incident. Of rows with one id the gravest counts."""
    c = F.col
    falling = lambda x: F.coalesce(0.0 - c(x), F.lit(float("nan")))  # noqa: E731  # unknown ones are last
    rows = hotspots.groupBy("id").agg(F.max(F.struct("risk_score", "frp")).alias("o"))
    nodes = rows.select("id", F.struct(falling("o.risk_score").alias("risk"), falling("o.frp").alias("frp"), "id").alias("key"))
    ranks = numbered(nodes, ["key"]).select("id", c("sequence").alias("rank"))
    return ranks, first_seeds(ranks, descents(hotspots, ranks, config))


def clusters(hotspots: DataFrame, config: Incidents = Incidents()) -> DataFrame:
    """(id, seed): the incident of every detection."""
    c = F.col
    ranks, tops = grouped(hotspots, config)
    named = tops.join(shuffled(ranks), "rank").select("id", "top")
    return named.join(shuffled(ranks.select(c("rank").alias("top"), c("id").alias("seed"))), "top").select("id", "seed")


def summarized(hotspots: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each incident: primary, counts, peak and mean frp, dominant source, centre, times, level, status."""
    c = F.col
    rows = hotspots.join(groups, "id").withColumn("at", detection_time())
    first = F.struct((-c("risk_score")).alias("r"), (-c("frp")).alias("f"), (-F.coalesce(F.unix_timestamp("at"), F.lit(0))).alias("t"), F.ascii("id").alias("c"), c("id").alias("id"), c("source_type").alias("source"), c("risk_level").alias("level"))
    sources = rows.groupBy("seed", "source_type").agg(F.count("*").alias("k"), F.min(first).alias("first"))
    primary = sources.groupBy("seed").agg(F.min("first").alias("p"), F.collect_list(F.struct("k", "source_type", "first")).alias("s"))
    # the most frequent source, then the primary's, then the first seen; at most seven sources in the list
    best = F.array_max(F.transform("s", lambda s: F.struct(s["k"].alias("k"), (s["source_type"] == c("p.source")).alias("own"), (-s["first"]["r"]).alias("r"), s["source_type"].alias("source"))))
    sums = rows.groupBy("seed").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("hotspot_ids"), F.max("frp").alias("peak_frp"),
        F.sum(F.floor(c("frp") * 100 + 0.5).cast("long")).alias("frp_cents"), F.bool_or("is_anomaly").alias("is_anomaly"),
        F.sum(F.floor(c("latitude") * 1e6 + 0.5).cast("long")).alias("lat6"), F.sum(F.floor(c("longitude") * 1e6 + 0.5).cast("long")).alias("lon6"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"),
    )
    level = c("p.level")
    status = F.when(level_rank(level) >= 2, "active").when((level == "medium") & c("is_anomaly"), "active").otherwise("monitoring")
    stamp = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return sums.join(primary, "seed").select(
        F.when(c("p.id").startswith("INC-"), c("p.id")).otherwise(F.concat(F.lit("INC-"), c("p.id"))).alias("incident_id"), c("p.id").alias("primary_id"), "n", "hotspot_ids",
        (-c("p.r")).alias("risk_score"), level.alias("risk_level"), half_up(c("peak_frp"), 2).alias("peak_frp"), half_up(c("frp_cents") / c("n") / 100.0, 2).alias("avg_frp"), "is_anomaly",
        best["source"].alias("source_type"), half_up(c("lat6") / c("n") / 1e6, 4).alias("latitude"), half_up(c("lon6") / c("n") / 1e6, 4).alias("longitude"),
        stamp("first_at").alias("first_seen"), stamp("last_at").alias("last_seen"), status.alias("status"),
    )


def aggregated(hotspots: DataFrame, config: Incidents = Incidents()) -> DataFrame:
    """Incidents, the gravest first."""
    ranks, tops = grouped(hotspots, config)
    groups = tops.join(shuffled(ranks), "rank").select("id", F.col("top").alias("seed"))
    return summarized(hotspots, groups).orderBy(F.desc("risk_score"), F.desc("peak_frp"), "incident_id")
