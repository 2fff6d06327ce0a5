"""Whitening of embeddings: principal components of the vectors' covariance, each scaled to variance 1.

One aggregation, made of generated SQL expressions, gives the sums of centred products of every pair of dimensions (the upper
triangle); the driver assembles the covariance of them and LAPACK takes it apart. Vectors are whole numbers, x = floor(64 * c) +
1000000; each distinct one counts once in the fit. Sums and deviations are exact, whatever the order of rows.

Passes: distinct vectors, written once; their number and sums; the products; the projection of all rows. What reaches the driver has
the size of the dimensions squared. `identity_error` is measured: the fitted vectors are projected and their covariance
aggregated in the same way.

Cases: rows whose vector is null or holds null or non-finite entries (or such as exceed a long) go, as do vectors whose length isn't the usual one (the commonest
length among the rest, the greater one if two are as common); repeated rows each give their rows; a null vec_id stays; of the
components at most `most` and at most as many as there are dimensions are given; a component without variance (a single
vector, or dimensions that depend on each other) has `whitened` null and doesn't count for `identity_error`, which is null if
none has any; equal eigenvalues keep LAPACK's order; the sign makes a component's largest entry positive; a deviation that
fits no long is null; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import work_path

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries from here on, or without bound, make a vector unusable: x must fit a long.
MOST = 2.0**56
#: A component whose eigenvalue is this small a part of the greatest has no variance but rounding's.
LEAST_SHARE = 1e-12
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # exact, of Python integers
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one component a column
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def usable(self) -> np.ndarray:
        return self.values > LEAST_SHARE * max(self.values[0], 0.0) if len(self.values) else np.zeros(0, bool)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of x; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.usable(), 1 / np.sqrt(np.maximum(self.values, 0)), np.nan)
        return ((x - self.mean) @ self.vectors) * scale


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and the vector x of whole numbers, of usable rows."""
    c = F.col("embedding")
    usable = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < MOST))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE) + SHIFT)
    rows = embeddings.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (usual.d if usual else 0))


def apart(table: DataFrame) -> DataFrame:
    """The table written once and read in a session of its own, in which a generated method that is too long for the JVM's
    compiler is cut up instead: thousands of sums in one method would be interpreted."""
    path = work_path(table.sparkSession, "whitening_fit")
    table.write.parquet(path)
    session = table.sparkSession.newSession()
    session.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return session.read.schema(table.schema).parquet(path)


def totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows of x and their sums by dimension, exact."""
    row = fit.selectExpr("count(*) AS n", *(f"sum(cast(x[{i}] AS decimal(20, 0))) AS s{i}" for i in range(d))).first()
    return row.n, [int(row[f"s{i}"] or 0) for i in range(d)]


def covariance(table: DataFrame, n: int, mean: list[float]) -> np.ndarray:
    """Covariance, with divisor n, of the columns v[0], v[1], ... of `table`: the upper triangle of sums of centred products, in one aggregation."""
    d = len(mean)
    centred = table.selectExpr(*(f"cast(v[{i}] AS double) - {float(m)!r}D AS c{i}" for i, m in enumerate(mean)))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = centred.selectExpr(*(f"sum(c{i} * c{j}) AS p{i}_{j}" for i, j in pairs)).first()
    out = np.zeros((d, d))
    for (i, j), value in zip(pairs, row, strict=True):
        out[i, j] = out[j, i] = (value or 0.0) / n
    return out


def fit(vectors: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors x of `whole_vectors`; None if there are none."""
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first.d
    unique = apart(vectors.select("x").distinct())
    n, sums = totals(unique, d)
    v = covariance(unique.select(F.col("x").alias("v")), n, [s / n for s in sums])
    values, components = np.linalg.eigh(v)
    values, components = values[::-1][:most], components[:, ::-1][:, :most]
    components = components * np.where(np.take_along_axis(components, np.abs(components).argmax(0)[None], 0)[0] < 0, -1.0, 1.0) if d else components
    model = Whitening(n, np.array(sums, object), values, components, float(np.trace(v)))
    k = int(model.usable().sum())
    if k:
        narrow = Whitening(n, model.sums, values[:k], components[:, :k], model.trace)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    w = narrow.project(matrix(batch.column(0), d).astype(float))
                    yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), k).cast(pa.list_(pa.float64()))], ["v"])

        white = unique.mapInArrow(run, "v array<double>")
        mean = white.selectExpr(*(f"avg(v[{i}]) AS m{i}" for i in range(k))).first()
        model.identity_error = float(np.abs(covariance(white, n, list(mean)) - np.eye(k)).max())
    return model


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of (n * x - S) squared, exact; None where it fits no long."""
    if not len(x):
        return []
    if n * float(np.abs(x).max(initial=0)) < 2.0**62 and max((abs(s) for s in sums), default=0) < 2**62:
        off = np.int64(n) * x - sums.astype(np.int64)
        if np.square(off.astype(float)).sum(1).max(initial=0) < 2.0**62:
            return np.square(off).sum(1).tolist()
    found = (sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x)
    return [v if v < 2**63 else None for v in found]


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """For each row of `whole_vectors` and each component, numbered from 1, a row of SCHEMA."""
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    k, d = len(model.values), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = np.maximum(model.values, 0) / model.trace if model.trace > 0 else np.zeros(k)
        for batch in batches:
            rows = batch.num_rows
            if rows and k:
                x = matrix(batch.column(1), d)
                w = model.project(x.astype(float)).ravel()
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)),
                        pa.array(deviations(x, model.n, model.sums), pa.int64()).take(each), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, rows)),
                        pa.array([model.identity_error] * (rows * k), pa.float64()),
                    ],
                    [f.split()[0] for f in SCHEMA.split(", ")],
                )

    return vectors.select("vec_id", "x").mapInArrow(run, SCHEMA)
