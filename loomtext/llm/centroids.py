"""Centroid clustering with exact integer distances, filtered by N-simplex projection.

Distances of every vector to a few pivots are computed once and written beside it. Pivots span a simplex; an
object's distances to them give its apex over that base, coordinates whose last is the height. Heights of two
objects may point either way, so the Euclidean distance of their apexes is a lower bound of the objects'
distance, and with one height turned round it is an upper bound. In every round only centroids whose
lower bound is not above the least upper bound are compared exactly. Bounds are widened by ``SLACK``
against rounding, so the filter drops no nearest centroid; ties go to the smaller number.

Sums of a cluster are made per task and then by (cluster, dimension); the driver holds centroids only.

Defined cases: rows whose vector is NULL, has another length or holds NULL, NaN or infinite entries are left
out. Rows are vectors of their own, repeated or not; rows of a NULL id are the last to become centroids, and
repeated ids go by their vectors. With fewer vectors than clusters there are as many clusters as vectors; an
empty table gives an empty result. Scaled entries of 2**27 or more end the job with an error, as distances would
not fit a long. Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loomtext.llm.vectors import finite, matrix, scaled, summed
from loomtext.scratch import materialise
from loomtext.session import ship_package

LIMIT = 1 << 27
#: Part of the squared distances to the first pivot by which bounds are widened.
SLACK = 1e-4
#: Least height of a pivot over the earlier ones, as a part of its distance to the first.
LEAST_HEIGHT = 0.05


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, a stated few."""
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1) if len(b) else np.zeros((len(a), 0), int)


class Simplex:
    """The base that pivots span, and apexes over it, from squared distances alone."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        between = squared(pivots, pivots).astype(float)
        first = between[0]
        gram = (first[1:, None] + first[None, 1:] - between[1:, 1:]) / 2
        self.first = first[1:]
        self.inverse = np.linalg.inv(np.linalg.cholesky(gram)) if len(pivots) > 1 else gram

    def apexes(self, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coordinates over the base, heights, and the squared distances to the first pivot."""
        d = distances.astype(float)
        near = d[:, 0]
        over = (near[:, None] + self.first[None, :] - d[:, 1:]) / 2 @ self.inverse.T
        return over, np.sqrt(np.maximum(near - (over**2).sum(1), 0)), near


def choose_pivots(vectors: np.ndarray, number: int) -> np.ndarray:
    """Up to ``number`` of the vectors, each the highest over the simplex of those before it."""
    chosen = vectors[:1]
    while len(chosen) < number:
        _, heights, near = Simplex(chosen).apexes(squared(vectors, chosen))
        high = np.where(heights > LEAST_HEIGHT * np.sqrt(near), heights, 0)
        if not high.any():
            break
        chosen = np.vstack([chosen, vectors[[int(high.argmax())]]])
    return chosen


class Assigner:
    """Nearest centroids of rows, by bounds and then exactly."""

    def __init__(self, simplex: Simplex, centroids: np.ndarray):
        self.simplex, self.centroids = simplex, centroids
        self.apexes = simplex.apexes(squared(centroids, simplex.pivots))

    def candidates(self, distances: np.ndarray) -> np.ndarray:
        """Whether a row's nearest centroid can be this one, by row and centroid."""
        (a, h, near), (b, g, far) = self.simplex.apexes(distances), self.apexes
        base = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T
        slack = SLACK * (near[:, None] + far[None, :] + 1)
        lower = base + (h[:, None] - g[None, :]) ** 2 - slack
        upper = base + (h[:, None] + g[None, :]) ** 2 + slack
        return lower <= upper.min(1)[:, None]

    def nearest(self, x: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of every row's nearest centroid."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        cluster = np.zeros(len(x), np.int64)
        for k, possible in enumerate(self.candidates(distances).T):
            rows = np.flatnonzero(possible)
            found = ((x[rows] - self.centroids[k]) ** 2).sum(1)
            closer = found < best[rows]
            best[rows[closer]], cluster[rows[closer]] = found[closer], k
        return cluster, best


def _with_distances(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows (id, x) with their squared distances to the pivots, written once for all rounds."""
    ship_package(rows.sparkSession)
    width = pivots.shape[1]
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("near array<bigint>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = squared(matrix(batch.column(1), width), pivots)
            ends = np.arange(len(near) + 1, dtype=np.int32) * len(pivots)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.names)

    return materialise(rows.mapInArrow(run, schema), "pivots")


def _moved(cached: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floored means of their vectors; empty ones stay."""
    k, width = centroids.shape
    n_pivots = len(simplex.pivots)

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        assigner, sums = Assigner(simplex, centroids), np.zeros((k, width + 1), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), width)
            cluster, _ = assigner.nearest(x, matrix(batch.column(1), n_pivots))
            for c in np.unique(cluster):
                mine = x[cluster == c]
                sums[c, :width] += mine.sum(0)
                sums[c, width] += len(mine)
        return sums.ravel()

    sums = summed(cached.select("x", "near"), partial, k * (width + 1), "long").reshape(k, width + 1)
    counts = sums[:, width:]
    return np.where(counts > 0, sums[:, :width] // np.maximum(counts, 1), centroids)


def cluster_vectors(
    vectors: DataFrame,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = 64,
    scale: int = 256,
    clusters: int = 40,
    rounds: int = 5,
    salt: str = "2:",
    pivots: int = 24,
) -> DataFrame:
    """Every kept row's id, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256``.

    Vectors become integers floor(``scale`` * entry). Centroids start as those whose id, after ``salt``, has
    the least SHA-256.
    """
    spark = vectors.sparkSession
    fits = finite(vector) & (F.size(vector) == dimensions)
    x = scaled(vector, scale, 0, LIMIT).alias("x")
    rows = vectors.where(fits).select(F.col(id).alias("_id"), x)
    order = F.sha2(F.concat(F.lit(salt), F.col("_id").cast("string")).cast("binary"), 256)
    least = rows.orderBy(order.asc_nulls_last(), "x").limit(clusters)
    start = np.array([r.x for r in least.select("x").collect()], np.int64)
    results = StructType(
        [StructField(id, rows.schema["_id"].dataType)]
        + StructType.fromDDL(
            "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        ).fields
    )
    if not len(start):
        return spark.createDataFrame([], results)
    simplex = Simplex(choose_pivots(start, pivots))
    cached = _with_distances(rows, simplex.pivots)
    centroids = start
    for _ in range(rounds):
        centroids = _moved(cached, simplex, centroids)

    n_pivots, last = len(simplex.pivots), centroids
    assigned = StructType([rows.schema["_id"], *StructType.fromDDL("cluster int, distance bigint").fields])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(simplex, last)
        for batch in batches:
            near = matrix(batch.column(2), n_pivots)
            cluster, distance = assigner.nearest(matrix(batch.column(1), dimensions), near)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=assigned.names,
            )

    placed = materialise(cached.select("_id", "x", "near").mapInArrow(assign, assigned), "clusters")
    totals = placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last.tolist()]
    per_cluster = spark.createDataFrame(
        [(r.cluster, r.s, sum(t.s for t in totals), digests[r.cluster]) for r in totals],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    # At most ``clusters`` rows.
    joined = placed.join(F.broadcast(per_cluster), "cluster")
    return joined.select(F.col("_id").alias(id), *results.names[1:])
