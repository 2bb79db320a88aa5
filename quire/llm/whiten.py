"""Whitening of vectors: covariance by sums of centred products, components by LAPACK.

One aggregation gives the count and the integer sum of each dimension; a second, generated
as Spark SQL, the sum of centred products of every pair of dimensions (the upper triangle).
What reaches the driver is one row each: d and d (d + 1) / 2 numbers.  There the covariance
is put together and decomposed; rows are projected where they are.

Nulls: a vector that is null, or has a component that is null or not finite, is left out.
Vectors of another length than the commonest (of equally common ones the longest) can't be
in one covariance and are left out too, as are empty ones.  A null id stays one.  Repeated
rows count as often as they occur.  No vectors give no rows.  A component along which nothing
varies (an eigenvalue of at most ``FLAT`` of the trace) has no whitened value (null) and isn't
in identity_error, which is 0 if there is no other; ``explained`` is null if the trace is 0.
``deviation`` is exact, and null if it isn't a long.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.balls import quantised, usable
from quire.llm.common import cut

#: Added to quantised components, so that all usual ones are positive.
SHIFT = 100_000
#: Share of the trace below which an eigenvalue counts as nothing.
FLAT = 1e-12


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): vectors with finite components as integers."""
    x = F.transform(quantised(F.col(vec_col)), lambda c: c + F.lit(SHIFT))
    return vectors.where(usable(F.col(vec_col))).select(F.col(id_col).alias("id"), x.alias("x")).where(F.size("x") > 0)


def totals(points: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension."""
    r = points.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i]) for i in range(dims)]).first()
    return r[0], list(r[1:])


def centred_products(dims: int) -> list[str]:
    """SQL of the sums of products of c0, c1, ...: the upper triangle, by rows."""
    return [f"sum(c{i} * c{j}) as p{i}_{j}" for i in range(dims) for j in range(i, dims)]


def covariance(points: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Of the vectors x, with divisor n: each component less its mean, then multiplied."""
    dims = len(sums)
    # columns that can't be null make sums of half the code
    centred = points.select(*[F.coalesce(F.col("x")[i].cast("double") - F.lit(s / n), F.lit(0.0)).alias(f"c{i}") for i, s in enumerate(sums)])
    row = centred.selectExpr(*centred_products(dims)).first()
    out = np.zeros((dims, dims))
    out[np.triu_indices(dims)] = np.array(row, np.float64) / n
    return out + np.triu(out, 1).T


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows; at most so many."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], vectors[:, order].T


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None if it isn't a long."""
    bound = n * max(int(x.max()), -int(x.min())) + max(map(abs, sums.tolist()))
    if bound * bound * x.shape[1] < 1 << 63:
        d = n * x - sums
        return (d * d).sum(1).tolist()
    d = x.astype(object) * n - sums.astype(object)
    return [v if v < 1 << 63 else None for v in (d * d).sum(1)]


def projected(points: DataFrame, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float) -> DataFrame:
    """(id, deviation, w): the whitened values of each vector, one a component."""
    kind = points.schema["id"].dataType.simpleString()
    s, mean = np.array(sums, np.int64), np.array([v / n for v in sums])
    flat = values <= FLAT * trace
    scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, values)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums))
            w = ((x - mean) @ vectors.T) / scale
            none = pa.array(np.broadcast_to(flat, w.shape).ravel())
            w = pa.array(w.ravel(), mask=none.to_numpy(zero_copy_only=False))
            rows = pa.ListArray.from_arrays(np.arange(0, len(w) + 1, len(values), dtype=np.int32), w)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(x, n, s), pa.int64()), rows], ["id", "deviation", "w"])

    return points.select("id", "x").mapInArrow(project, f"id {kind}, deviation long, w array<double>")


def _identity_error(rows: DataFrame, n: int, live: list[int]) -> float:
    """The largest entry of the covariance of the whitened values minus the identity."""
    if not live:
        return 0.0
    means = rows.agg(*[F.sum(F.col("w")[i]) for i in live]).first()
    centred = rows.select(*[(F.col("w")[i] - F.lit(m / n)).alias(f"c{k}") for k, (i, m) in enumerate(zip(live, means))])
    row = np.array(centred.selectExpr(*centred_products(len(live))).first(), np.float64) / n
    return float(np.abs(row - np.eye(len(live))[np.triu_indices(len(live))]).max())


def whiten(vectors: DataFrame, most: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row for each
    vector and component, numbered from 1 by falling eigenvalue."""
    points = integers(vectors, id_col, vec_col)
    kind = points.schema["id"].dataType.simpleString()
    common = points.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return points.sparkSession.createDataFrame([], f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    dims = common["d"]
    points = points.where(F.size("x") == dims)
    n, sums = totals(points, dims)
    cov = covariance(points, n, sums)
    trace = float(np.trace(cov))
    values, axes = components(cov, min(most, dims))
    rows = cut(projected(points, n, sums, values, axes, trace), "projected")
    error = _identity_error(rows, n, [i for i, v in enumerate(values) if v > FLAT * trace])
    shares: list[Column] = [F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values]
    out = rows.select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select("id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(F.array(*shares), F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
