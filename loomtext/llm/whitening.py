"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries become integers, so sums over the table are exact and rows are centred before anything is multiplied.
Every step sends one vector through the rows: a task multiplies its centred rows X by v and the outcome by the
rows again, block by block, and only sums leave it. Left vectors, one entry a row of the table, are never
stored: each is X times a short vector that the driver knows. Both sides are orthogonalised against all
earlier vectors. The small bidiagonal matrix is decomposed on the driver; steps end when the wanted
singular vectors have converged to double precision and what no step has reached has less variance than
the last of them, so that equal deviations are not overlooked, or after as many steps as dimensions.

Defined cases: rows whose vector is NULL or holds NULL, NaN or infinite entries are left out, and so are rows with
another length than the commonest (of equally common ones, the longest). Rows are vectors of their own,
repeated or not. Components with no deviation to speak of (``NO_DEVIATION`` of the first) are not given, so a
table of equal vectors or of one gives none; an empty table gives an empty result. ``deviation`` is NULL where
it does not fit a long. Entries of 2**31 or more when scaled end the job with an error. Columns other than the
id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loomtext.llm.vectors import finite, matrix, scaled, summed
from loomtext.scratch import materialise
from loomtext.session import ship_package

LIMIT = (1 << 31) - 1
#: Residual, as a part of the largest singular value, at which a singular vector has converged.
CONVERGED = 1e-15
#: Singular values below this part of the first count as none.
NO_DEVIATION = 1e-9
SEED = 13
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Centre:
    """Number of rows and exact sums of every dimension."""

    n: int
    sums: np.ndarray

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, as integers that do not overflow."""
        largest = int(np.abs(x).max(initial=0)) + int(np.abs(self.sums).max(initial=0)) // self.n + 1
        if largest * self.n < 1 << 62:
            return self.n * x - self.sums
        return self.n * x.astype(object) - self.sums.astype(object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Centred rows."""
        return self.exact(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of ``exact``."""
        centred = self.exact(x)
        if centred.dtype != object and (centred.astype(float) ** 2).sum(1).max(initial=0) >= 2.0**62:
            centred = centred.astype(object)
        return [v if v <= LONG else None for v in (centred**2).sum(1).tolist()]


def _centre(cached: DataFrame, width: int) -> Centre:
    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros(width + 1, np.int64)
        for batch in batches:
            sums[:width] += matrix(batch.column(0), width).sum(0)
            sums[width] += batch.num_rows
        return sums

    sums = summed(cached.select("x"), partial, width + 1, "long")
    return Centre(int(sums[width]), sums[:width])


@dataclass
class Product:
    """What one pass over the rows gives for p = Xv: XᵀP, the inner products of p with the left vectors,
    p's squared length, and the squared length of all rows."""

    back: np.ndarray
    along: np.ndarray
    squared: float
    total: float


def multiply(cached: DataFrame, centre: Centre, v: np.ndarray, left: np.ndarray) -> Product:
    """One pass. ``left``: a column for every left vector, which is X times that column."""
    width, k = left.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        back, along, squared, total = np.zeros(width), np.zeros(k), 0.0, 0.0
        for batch in batches:
            rows = centre.rows(matrix(batch.column(0), width))
            p = rows @ v
            back += rows.T @ p
            along += (rows @ left).T @ p
            squared += p @ p
            total += (rows * rows).sum()
        return np.concatenate([back, along, [squared, total]])

    sums = summed(cached.select("x"), partial, width + k + 2, "double")
    return Product(sums[:width], sums[width:-2], sums[-2], sums[-1])


def orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``v`` without its parts along the columns of ``basis``, taken off twice."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalise(multiplied, width: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest singular values of X, up to ``wanted``, its right singular vectors as columns, and the
    squared length of all rows. ``multiplied(v, left)`` gives a ``Product``."""
    rng = np.random.default_rng(SEED)
    right, left, images = (np.zeros((width, 0)) for _ in range(3))
    alphas: list[float] = []
    betas: list[float] = []
    reached = 0.0
    v = rng.standard_normal(width)
    v /= np.linalg.norm(v)
    while True:
        # X v = beta u' + alpha u, where u' is the left vector before.
        w = v - betas[-1] * left[:, -1] if betas else v
        product = multiplied(w, left)
        scale = np.sqrt(product.total)
        w, back = w - left @ product.along, product.back - images @ product.along
        alpha = np.sqrt(max(product.squared - product.along @ product.along, 0.0))
        if alpha > 1e-14 * scale:
            w, back = w / alpha, back / alpha
        else:
            alpha, w, back = 0.0, np.zeros(width), np.zeros(width)
        right, left = np.column_stack([right, v]), np.column_stack([left, w])
        images = np.column_stack([images, back])
        reached += alpha**2 + (betas[-1] ** 2 if betas else 0.0)
        alphas.append(alpha)
        # Xᵀu = alpha v + beta v'', where v'' is the right vector to come.
        rest = orthogonal(back - alpha * v, right)
        beta = float(np.linalg.norm(rest))
        small = np.diag(alphas) + np.diag(betas, 1)
        ends, values, turned = np.linalg.svd(small)
        found = min(wanted, width, len(values))
        residual = np.abs(beta * ends[-1, :found]).max(initial=0)
        unreached = product.total - reached
        sure = found == min(wanted, width) and residual <= CONVERGED * max(values[0], 1e-300)
        if len(alphas) == width or scale == 0 or (sure and unreached < values[found - 1] ** 2):
            return values[:found], right @ turned[:found].T, product.total
        if beta <= 1e-14 * scale:
            beta, rest = 0.0, orthogonal(rng.standard_normal(width), right)
        betas.append(beta)
        v = rest / np.linalg.norm(rest)


def whiten(
    vectors: DataFrame,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    components: int = 8,
    scale: int = 1024,
    offset: int = 100_000,
) -> DataFrame:
    """One row per kept row and component: id, ``component`` from 1, ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error``.

    Entries become floor(``scale`` * entry) + ``offset``.
    """
    spark = vectors.sparkSession
    x = scaled(vector, scale, offset, LIMIT).alias("x")
    rows = vectors.where(finite(vector)).select(F.col(id).alias("_id"), x)
    results = StructType(
        [StructField(id, rows.schema["_id"].dataType)]
        + StructType.fromDDL(
            "component int, n bigint, deviation bigint, whitened double, explained double, "
            "identity_error double"
        ).fields
    )
    written = materialise(rows, "embeddings")
    lengths = written.groupBy(F.size("x").alias("width")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = common[0].width if common else 0
    if not width:
        return spark.createDataFrame([], results)
    cached = written.where(F.size("x") == width)
    centre = _centre(cached, width)
    values, axes, total = bidiagonalise(
        lambda v, left: multiply(cached, centre, v, left), width, components
    )
    some = values > NO_DEVIATION * values[0] if values[0] > 0 else np.zeros(len(values), bool)
    values, axes = values[some], axes[:, some]
    if not len(values):
        return spark.createDataFrame([], results)
    k, n = len(values), centre.n
    projection = axes / (values / np.sqrt(n))
    explained = values**2 / total

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = centre.rows(matrix(batch.column(0), width)) @ projection
            sums += y.sum(0)
            products += y.T @ y
        return np.concatenate([sums, products.ravel()])

    sums = summed(cached.select("x"), moments, k + k * k, "double") / n
    covariance = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])
    error = float(np.abs(covariance - np.eye(k)).max())
    ship_package(spark)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array([d for d in centre.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array((centre.rows(x) @ projection).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=results.names,
            )

    return cached.select("_id", "x").mapInArrow(project, results)
