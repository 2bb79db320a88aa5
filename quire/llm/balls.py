"""Clusters of vectors around centroids: exact rounds of Lloyd's method, filtered by ball trees.

Vectors are packed once into metric trees of at most BLOCK vectors of one partition and
written to the shared folder.  Each ball stores its radius, its count and the integer sum of
its vectors (which gives its centre).  In a round a ball goes to one centroid as a whole when
the triangle inequality says that no other can be nearer to anything in it; else its halves
are asked, and at the leaves distances are exact integers.  A round sends from each task one
row of sums for each centroid, and ``k`` rows reach the driver, whatever the input.

Nulls: a vector that is null, has another number of components, or a component that is null
or not finite has no place and is left out; a null id stays a null id, and hashes as an empty
one.  Ties go to the centroid with the smaller number; an empty centroid stays where it is.
Repeated rows count as often as they occur; of equal ids the smaller vector comes first where
centroids are chosen.  No vectors give no rows; fewer vectors than ``k``, as many centroids.
Squared distances are longs: a component beyond ``largest(dims)`` is an error.  Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut

#: Vectors of a tree, and of a leaf.
BLOCK, LEAF = 4096, 24
#: What a component is multiplied by before it is rounded down.
SCALE = 1024


def largest(dims: int) -> int:
    """The largest absolute component for which all squared distances are longs."""
    return math.isqrt(((1 << 63) - 1) // dims) // 2


def usable(vector: Column, dims: int | None = None) -> Column:
    """Whether a vector has ``dims`` components (if given), all of them finite numbers."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce(finite if dims is None else (F.size(vector) == dims) & finite, F.lit(False))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Components as integers: floor(scale * x), with x as double."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))


def first_centroids(points: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``<salt>:<id>``, in that order."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = points.select(name.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


# --- trees ------------------------------------------------------------------------------------


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A metric tree: the order of the points, and for each ball, parents first, (start, end,
    left child or -1; the right child follows it), radius and integer sum."""
    order = np.arange(len(points))
    spans, radii, sums, at = [[0, len(points), -1]], [], [], 0
    while at < len(spans):
        lo, hi, _ = spans[at]
        own = points[order[lo:hi]]
        total = own.sum(0)
        from_centre = ((own - total / len(own)) ** 2).sum(1)
        radii.append(math.sqrt(from_centre.max()) * (1 + 1e-9))
        sums.append(total)
        if hi - lo > LEAF and radii[-1] > 0:
            one = own[from_centre.argmax()]
            other = own[((own - one).astype(np.float64) ** 2).sum(1).argmax()]
            half = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own @ (other - one).astype(np.float64), half)]
            spans[at][2] = len(spans)
            spans += [[lo, lo + half, -1], [lo + half, hi, -1]]
        at += 1
    return order, np.array(spans, np.int32), np.array(radii), np.array(sums, np.int64)


def assigned(points: np.ndarray, spans: np.ndarray, radii: np.ndarray, sums: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(ball, centroid) of the balls that go as a whole, the places of all other points, and
    their centroids."""
    k = len(centroids)
    whole: list[tuple[int, int]] = []
    rows, open_to = [], []
    balls, may = np.zeros(1, np.int64), np.ones((1, k), bool)
    where = centroids.astype(np.float64)
    while len(balls):
        n = spans[balls, 1] - spans[balls, 0]
        centre = sums[balls] / n[:, None]
        d = np.sqrt(((centre[:, None, :] - where[None]) ** 2).sum(2))
        d[~may] = np.inf
        near = d.min(1) + radii[balls]
        # nothing in the ball is further than near from the nearest, or closer than d - radius to another
        may = may & (np.where(may, d, 0) * (1 - 1e-9) - radii[balls][:, None] <= near[:, None] * (1 + 1e-9) + 1e-6)
        single = may.sum(1) == 1
        whole += zip(balls[single].tolist(), may[single].argmax(1).tolist())
        end = ~single & (spans[balls, 2] < 0)
        for ball, m in zip(balls[end], may[end]):
            rows.append(np.arange(spans[ball, 0], spans[ball, 1]))
            open_to.append(np.broadcast_to(m, (len(rows[-1]), k)))
        deeper = ~single & ~end
        left = spans[balls[deeper], 2].astype(np.int64)
        balls, may = np.concatenate([left, left + 1]), np.concatenate([may[deeper], may[deeper]])
    if not rows:
        return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, mask = np.concatenate(rows), np.concatenate(open_to)
    best, winner = np.full(len(places), np.iinfo(np.int64).max), np.zeros(len(places), np.int64)
    for c in range(k):
        mine = np.flatnonzero(mask[:, c])
        d = ((points[places[mine]] - centroids[c]) ** 2).sum(1)
        closer = d < best[mine]
        best[mine[closer]], winner[mine[closer]] = d[closer], c
    return whole, places, winner


def trees(points: DataFrame, dims: int) -> DataFrame:
    """(ids, points, spans, radii, sums): trees of the vectors (id, x), each of one partition."""
    kind = points.schema["id"].dataType.simpleString()
    most = largest(dims)

    def packed(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        if len(x) and max(int(x.max()), -int(x.min())) > most:
            raise ValueError(f"a component is beyond {most}: squared distances aren't longs")
        order, spans, radii, sums = build(x)
        values = {"ids": pa.ListArray.from_arrays([0, len(ids)], ids.take(pa.array(order))), "points": [x[order].tobytes()], "spans": [spans.tobytes()], "radii": [radii.tobytes()], "sums": [sums.tobytes()]}
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, pa.binary()) for v in values.values()], list(values))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, waiting = [], [], 0

        def grown() -> Iterator[pa.RecordBatch]:
            if xs:
                yield packed(pa.concat_arrays(ids), np.concatenate(xs))

        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                if waiting and waiting + part.num_rows > BLOCK:
                    yield from grown()
                    ids, xs, waiting = [], [], 0
                ids.append(part.column(0))
                xs.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                waiting += part.num_rows
        yield from grown()

    return points.select("id", "x").mapInArrow(plant, f"ids array<{kind}>, points binary, spans binary, radii binary, sums binary")


def _trees_of(batch: pa.RecordBatch, dims: int) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        raw = [batch.column(c)[i].as_py() for c in (1, 2, 3, 4)]
        yield batch.column(0)[i].values, np.frombuffer(raw[0], np.int64).reshape(-1, dims), np.frombuffer(raw[1], np.int32).reshape(-1, 3), np.frombuffer(raw[2]), np.frombuffer(raw[3], np.int64).reshape(-1, dims)


def sums_of(forest: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(centroid, count, sums) of the vectors nearest to each centroid that has any."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, points, spans, radii, sums in _trees_of(batch, dims):
                whole, places, winner = assigned(points, spans, radii, sums, centroids)
                for ball, c in whole:
                    n[c] += spans[ball, 1] - spans[ball, 0]
                    s[c] += sums[ball]
                for c in np.unique(winner):
                    mine = places[winner == c]
                    n[c] += len(mine)
                    s[c] += points[mine].sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(n[some]), "s": pa.array(s[some].tolist(), pa.list_(pa.int64()))})

    each = forest.mapInArrow(add, "cluster int, n long, s array<bigint>")
    total = each.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dims)]).alias("s"))
    return [(r["cluster"], r["n"], r["s"]) for r in total.collect()]


def members(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance): the nearest centroid of each vector and the squared distance."""
    dims = centroids.shape[1]
    kind = forest.schema["ids"].dataType.elementType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, points, spans, radii, sums in _trees_of(batch, dims):
                whole, places, winner = assigned(points, spans, radii, sums, centroids)
                cluster = np.zeros(len(points), np.int64)
                cluster[places] = winner
                for ball, c in whole:
                    cluster[spans[ball, 0] : spans[ball, 1]] = c
                distance = ((points - centroids[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    return forest.mapInArrow(place, f"id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3", dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of the usable vectors after ``rounds`` rounds, and the final
    centroids.  A round sends every vector to its nearest centroid and moves each centroid
    that has any to their mean, rounded down."""
    points = vectors.where(usable(F.col(vec_col), dims)).select(F.col(id_col).alias("id"), quantised(F.col(vec_col)).alias("x"))
    centroids = first_centroids(points, k, salt)
    if not len(centroids):
        return points.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dims), np.int64)
    forest = cut(trees(points, dims), "trees")
    for _ in range(rounds):
        moved = centroids.copy()
        for c, n, s in sums_of(forest, centroids):
            moved[c] = [x // n for x in s]
        if (moved == centroids).all():
            break  # all later rounds would be the same
        centroids = moved
    return members(forest, centroids), centroids


def with_inertia(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256 (of the components, joined by
    commas).  What is joined has a row for each centroid."""
    if not len(centroids):
        return clustered.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    rows = cut(clustered, "members")
    parts = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = F.array(*[F.struct(F.lit(parts.get(c, 0)).cast("long").alias("own"), F.lit(hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()).alias("sha")) for c, x in enumerate(centroids.tolist())])
    own = F.get(facts, F.col("cluster"))
    return rows.select("*", own["own"].alias("cluster_inertia"), F.lit(sum(parts.values())).cast("long").alias("inertia"), own["sha"].alias("centroid_sha256"))
