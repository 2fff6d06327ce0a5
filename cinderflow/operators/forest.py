"""Isolation forest (Liu, Ting, Zhou: ICDM 2008) over frp, brightness and persistence.

Each tree grows on its own sub-sample of the whole population (256 rows, the least by a hash salted with the tree's number,
so the same at any partitioning). Where a tree cuts is drawn from digests of its number and the node's path, so that the fit depends on
the rows alone and any engine with MD5 can repeat it. The fitted forest is a table of nodes (`node_table`); its arrays travel to the
executors, where Arrow batches of the whole population walk down them; the threshold is a percentile over the scores of all rows.
Depths are added up in whole millionths, so equal rows have equal scores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Anomaly
from ..functions.common import half_up
from ..plans.lineage import staged

INPUTS = ("f_frp", "f_brightness", "persistence_score")
RANK_ACCURACY = 100_000
#: A row's place in a tree's order is (a + b * tree) modulo this prime, a and b being parts of its id's digest.
PRIME = 2_147_483_647
UNIT = 1_000_000  # of depth


class Unfit(ValueError):
    """A population that no forest can be fitted on."""


def usual_depth(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n < 3 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def drawn(seed: int, tree: int, path: str, what: str) -> float:
    """A number from 0 up to 1 for a node."""
    return int(hashlib.md5(f"{seed}:{tree}:{path}:{what}".encode()).hexdigest()[:8], 16) / 2.0**32


@dataclass
class Tree:
    """Nodes in arrays, the root first; path: the L and R that lead to a node; feature -1 is a leaf; depth: of a leaf, with what is
    usual for the rows that share it, in UNITs."""

    path: list[str]
    size: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray


def grow(x: np.ndarray, tree: int, seed: int, limit: int) -> Tree:
    nodes: list[list] = []
    pending = [(x, "", -1)]
    while pending:
        rows, path, parent = pending.pop()
        if parent >= 0:
            nodes[parent][4 if path.endswith("L") else 5] = len(nodes)
        low, high = (rows.min(0), rows.max(0)) if len(rows) else np.zeros((2, x.shape[1]))  # a cut may leave one side without rows
        can = np.flatnonzero(high > low)
        if len(path) >= limit or len(rows) < 2 or not len(can):
            nodes.append([path, len(rows), -1, 0.0, -1, -1, len(path) * UNIT + int(np.floor(usual_depth(len(rows)) * UNIT + 0.5))])
            continue
        f = int(can[int(drawn(seed, tree, path, "feature") * len(can))])
        cut = float(low[f] + drawn(seed, tree, path, "cut") * (high[f] - low[f]))
        below = rows[:, f] < cut
        pending += [(rows[~below], path + "R", len(nodes)), (rows[below], path + "L", len(nodes))]
        nodes.append([path, len(rows), f, cut, -1, -1, 0])
    columns = list(zip(*nodes, strict=True))
    return Tree(list(columns[0]), *map(np.array, columns[1:]))


def walk(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Depth of each row's leaf."""
    node = np.zeros(len(x), int)
    while True:
        f = tree.feature[node]
        go = f >= 0
        if not go.any():
            return tree.depth[node]
        at = node[go]
        node[go] = np.where(x[go, f[go]] < tree.cut[at], tree.left[at], tree.right[at])


def scores(trees: list[Tree], x: np.ndarray, sample: int) -> np.ndarray:
    """2 ** (-mean depth / usual depth): near 1 for outliers."""
    total = np.sum([walk(t, x) for t in trees], 0)
    return 2.0 ** (-(total / (len(trees) * float(UNIT))) / max(1e-9, usual_depth(sample)))


def sub_samples(population: DataFrame, size: int, trees: int, seed: int) -> list[np.ndarray]:
    """For each tree the `size` rows of the whole population (all, if there are fewer) that come first by (a + b * tree) % PRIME;
    the same at any partitioning. A bound on that lets some more than `size` rows a tree reach the
    driver, whatever the population's size; if chance leaves a tree too few, the bound is raised."""
    n = population.count()
    wanted = min(size, n)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % PRIME
    keyed = population.select("id", *INPUTS, part(1).alias("a"), part(9).alias("b"))
    share = min(1.0, (size + 8 * size**0.5 + 16) / max(1, n))
    while True:
        bound = int(share * PRIME) + 1
        ranks = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), ((F.col("a") + F.col("b") * (t + 1)) % PRIME).alias("h")))
        some = keyed.select("id", *INPUTS, F.explode(F.filter(ranks, lambda r: r["h"] < bound)).alias("r")).select("id", *INPUTS, "r.*")
        found: list[list[list[float]]] = [[] for _ in range(trees)]
        # repeated rows have one hash: they come once, with their number
        for r in sorted(some.groupBy("tree", "h", "id", *INPUTS).count().collect(), key=lambda r: (r.tree, r.h, str(r.id), *(r[c] for c in INPUTS))):
            found[r.tree] += [[r[c] for c in INPUTS]] * min(r["count"], wanted - len(found[r.tree]))
        if share >= 1 or all(len(x) == wanted for x in found):
            return [np.array(x, float).reshape(-1, len(INPUTS)) for x in found]
        share = min(1.0, 4 * share)


def fit(population: DataFrame, config: Anomaly = Anomaly()) -> tuple[list[Tree], int]:
    """Trees, each grown on its own sub-sample of the population, and the sub-samples' size. Unfit without rows, or where they
    aren't all finite."""
    samples = sub_samples(population, config.sample, config.trees, config.seed)
    size = len(samples[0])
    if not size or not all(np.isfinite(x).all() for x in samples):
        raise Unfit("no rows, or values that aren't finite")
    limit = int(np.ceil(np.log2(max(2, size))))
    return [grow(x, t, config.seed, limit) for t, x in enumerate(samples)], size


def node_table(spark: SparkSession, trees: list[Tree]) -> DataFrame:
    """(tree, path, size, feature, cut, depth): the forest; feature and cut are null at leaves, depth (in millionths) elsewhere."""
    rows = [
        (k, path, int(n), None if f < 0 else int(f), None if f < 0 else float(cut), int(depth) if f < 0 else None)
        for k, t in enumerate(trees) for path, n, f, cut, depth in zip(t.path, t.size, t.feature, t.cut, t.depth, strict=True)
    ]
    return spark.createDataFrame(rows, "tree long, path string, size long, feature long, cut double, depth long")


def threshold_of(scored: DataFrame, contamination: float) -> float:
    """The score above which the contamination share of all rows lies, between ranks as by numpy's quantile. Ranks are exact
    on small tables, else within 1 / RANK_ACCURACY of the rows."""
    n = scored.count()
    if not n:
        return 1.0
    at = (1 - contamination) * (n - 1)
    low = int(at)
    ranks = [(low + 0.5) / n, (min(low + 1, n - 1) + 0.5) / n]
    a, b = scored.agg(F.percentile_approx("score", ranks, RANK_ACCURACY).alias("p")).first().p
    return a + (at - low) * (b - a)


def population_stats(rows: DataFrame, column: str = "f_frp") -> DataFrame:
    """mean and population deviation (1 at least) of the whole population, one row: an aggregate, not an unpartitioned window."""
    return rows.agg(F.avg(column).alias("mean"), F.greatest(F.stddev_pop(column), F.lit(1.0)).alias("std"), F.count(F.lit(1)).alias("n"))


def anomaly_forest(population: DataFrame, config: Anomaly = Anomaly()) -> DataFrame:
    """(id, is_outlier, outlier_score, deviation) of each row of `features` rows. Unfit as by `fit`, or if any row isn't finite."""
    return scored_by_forest(staged(population.select("id", *INPUTS), "population"), config)


def scored_by_forest(population: DataFrame, config: Anomaly) -> DataFrame:
    """`anomaly_forest` of a written table."""
    odd = population.where(" or ".join(f"{c} is null or isnan({c}) or abs({c}) = double('inf')" for c in INPUTS))
    if not odd.isEmpty():
        raise Unfit("values that aren't finite")
    trees, sample = fit(population, config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 4)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores(trees, x, sample))], ["id", "f_frp", "score"])

    scored = staged(population.mapInArrow(run, "id string, f_frp double, score double"), "scores")
    raw = scored.select("id", "f_frp", (F.lit(threshold_of(scored, config.contamination)) - F.col("score")).alias("raw"))
    joined = raw.join(F.broadcast(population_stats(population)))  # one row
    score, z = 1 / (1 + F.exp(6 * F.col("raw"))), (F.col("f_frp") - F.col("mean")) / F.col("std")
    outlier = (F.col("raw") < 0) | (score >= config.least_score) | (z >= config.sigma)
    return joined.select("id", outlier.alias("is_outlier"), half_up(score, 3).alias("outlier_score"), half_up(z, 2).alias("deviation"))


def population_outliers(population: DataFrame, config: Anomaly = Anomaly()) -> tuple[DataFrame, bool]:
    """(id, is_outlier, outlier_score, deviation), and whether by forest: that needs five rows or more, all finite; else the fixed
    baseline decides. `features` rows come in; what they are made from is computed once."""
    from .intelligence import anomaly_zscore

    written = staged(population.select("id", *INPUTS, "prior_30d", "recurrent"), "population")
    if written.limit(5).count() == 5:
        try:
            return scored_by_forest(written, config), True
        except Unfit:
            pass
    return anomaly_zscore(written, config).select("id", "is_outlier", "outlier_score", "deviation"), False


def anomalies(population: DataFrame, config: Anomaly = Anomaly()) -> DataFrame:
    """By forest for five finite rows or more, else by the fixed baseline."""
    return population_outliers(population, config)[0]
