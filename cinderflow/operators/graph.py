"""Connected components of an edge table of any size, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import staged


def _summary(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, int(row.h or 0)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (large: the greater ones; small: the lesser ones and itself) go to its least neighbour.

    The least neighbour comes from an aggregate with partial sums and a join, never from a collected neighbour list, so
    a node of very many neighbours is no single task's burden.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component) of each node that has an edge; component is the least id in reach. ids may be of any ordered type.

    An edge with a null end is no edge, nor is one from a node to itself; repeated edges count once; no edges, no rows. Rounds grow with the logarithm
    of the longest path; if they don't suffice an error is raised.
    """
    now = staged(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    seen = _summary(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = staged(_star(_star(now, True), False), "edges")
        new = _summary(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    members = now.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("id"), "component")).distinct()
