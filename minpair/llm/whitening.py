"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Entries become integers, ``floor(scale * entry)``, so counts, sums and the scatter of the distinct
vectors are exact whatever the order in which tasks add them up. The centred scatter (a matrix of one
row and column a dimension, the only thing that comes to the driver) is factored with diagonal
pivots, ``V = L L'``; Jacobi rotations are then applied to the columns of ``L`` itself until all pairs
are orthogonal. The rotated columns' squared norms are the eigenvalues, and the columns over their norms
are the components. ``L L'`` is never formed again, so small eigenvalues keep their digits.

Distinct vectors are found by a group on the vector itself, combined before the shuffle; each task sends
one row for each pair of dimensions.

Edge cases: vectors that are null or hold null, NaN or infinite entries are dropped; of several lengths
the most frequent one stays (of equally frequent ones the longest), empty vectors give no component;
entries beyond a long's range end there; null and repeated ids and repeated vectors keep their rows;
directions without variance are no components, so a table of equal vectors, or an empty one, gives no
row; a deviation beyond a long's range is null; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minpair.session import materialise

SCALE = 256
#: Whole numbers up to which doubles are exact.
EXACT = 2 ** 53
MOST_SWEEPS = 60


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """``floor(scale * entry)`` of every entry, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of two integer matrices: in doubles where all sums fit, else in Python's integers."""
    most = [max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a.astype(object) @ b.astype(object)


@dataclass
class Moments:
    """Number of vectors, their sums by dimension, and sums of products of dimensions, all exact."""

    n: int
    sums: list[int]
    products: dict[tuple[int, int], int]

    def covariance(self) -> np.ndarray:
        """``(n * products - sums * sums) / n**2``, each entry rounded once."""
        v = np.zeros((len(self.sums),) * 2)
        for (i, j), p in self.products.items():
            v[i, j] = v[j, i] = (self.n * p - self.sums[i] * self.sums[j]) / self.n ** 2
        return v


def moments(fit: DataFrame, size: int) -> Moments:
    """Of the column ``x`` of ``fit``. A task's sums go out in two parts, which no number of tasks
    brings over a decimal's range."""
    upper = np.triu_indices(size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            x = matrix(batch.column("x"), size)
            n += len(x)
            sums += times(np.ones((1, len(x)), np.int64), x)[0].astype(object)
            products += times(x.T, x).astype(object)
        if n:
            values = [n, *sums.tolist(), *products[upper].tolist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([-1] * (size + 1) + upper[0].tolist(), pa.int32()), pa.array([-1, *range(size), *upper[1].tolist()], pa.int32()),
                decimals([v >> 64 for v in values]), decimals([v & (2 ** 64 - 1) for v in values])], names=["i", "j", "high", "low"])

    rows = fit.select("x").mapInArrow(add, "i int, j int, high decimal(38,0), low decimal(38,0)").groupBy("i", "j").agg(
        F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    values = {(r["i"], r["j"]): (int(r["high"]) << 64) + int(r["low"]) for r in rows}
    return Moments(values.get((-1, -1), 0), [values.get((-1, j), 0) for j in range(size)],
                   {k: v for k, v in values.items() if k[0] >= 0})


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``L`` with ``L L' = v`` and a column for each direction that has variance; its rows, in the order
    of the pivots, are a lower triangle."""
    left = v.astype(np.float64).copy()
    least = len(v) * np.finfo(np.float64).eps * max(left.diagonal().max(initial=0.0), 0.0)
    columns: list[np.ndarray] = []
    done = np.zeros(len(v), bool)
    while not done.all():
        diagonal = np.where(done, -np.inf, left.diagonal())
        at = int(diagonal.argmax())
        if diagonal[at] <= least:
            break
        column = np.where(done, 0.0, left[:, at]) / np.sqrt(diagonal[at])
        left -= np.outer(column, column)
        done[at] = True
        columns.append(column)
    return np.column_stack(columns) if columns else np.zeros((len(v), 0))


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of ``factor factor'``: sweeps over all pairs of
    columns, dealt like the rounds of a tournament, so that a round's rotations don't touch each other."""
    a = factor.copy()
    count = a.shape[1] + a.shape[1] % 2
    a = np.column_stack([a, np.zeros((len(a), count - a.shape[1]))])
    seats = np.arange(count)
    for _ in range(MOST_SWEEPS):
        worst = 0.0
        for _ in range(max(0, count - 1)):
            p, q = seats[:count // 2], seats[count // 2:][::-1]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            scale = np.sqrt(xx * yy)
            turn = (scale > 0) & (np.abs(xy) > np.finfo(np.float64).eps * scale)
            worst = max(worst, float((np.abs(xy[turn]) / scale[turn]).max(initial=0.0)))
            safe = np.where(turn, xy, 1.0)
            zeta = (yy - xx) / (2 * safe)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            c, s = np.where(turn, c, 1.0), np.where(turn, c * t, 0.0)
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])
        if worst < 4 * np.finfo(np.float64).eps:
            break
    values = (a * a).sum(axis=0)
    order = np.argsort(-values, kind="stable")[:factor.shape[1]]
    order = order[values[order] > 0]
    vectors = a[:, order] / np.sqrt(values[order])
    # The entry that is largest without its sign is positive.
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]) if len(order) else np.zeros(0)
    return values[order], vectors * signs


@dataclass
class Whitening:
    """Mean (``sums / n``) and the leading components with their eigenvalues and shares of the variance."""

    size: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if self.n * most + max(map(abs, self.sums), default=0) < 2 ** 63:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        most = max(int(centred.max(initial=0)), -int(centred.min(initial=0)))
        if self.size * most * most < 2 ** 63:
            return (centred * centred).sum(axis=1).tolist()
        exact = [sum(v * v for v in row) for row in centred.astype(object).tolist()]
        return [v if v < 2 ** 63 else None for v in exact]


def train(fit: DataFrame, size: int, components: int = 4) -> Whitening | None:
    """From distinct vectors ``x``; None if nothing varies."""
    m = moments(fit, size)
    if m.n == 0:
        return None
    v = m.covariance()
    values, vectors = jacobi(pivoted_cholesky(v))
    if not len(values):
        return None
    return Whitening(size, m.n, m.sums, values[:components], vectors[:, :components], values[:components] / np.trace(v))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity. Centred vectors
    add up to zero in exact integers, so their projections need no further centring."""
    count = len(model.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, count))
        for batch in batches:
            w = model.project(model.centred(matrix(batch.column("x"), model.size)))
            total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())],
                                         names=["i", "j", "s"])

    rows = fit.select("x").mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max(abs(r["s"] / model.n - (r["i"] == r["j"])) for r in rows)


def whiten(vectors: DataFrame, components: int = 4, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for every vector
    and component, numbered from 1."""
    result = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = vectors.where(finite(F.col(vector))).select(F.col(vec_id).alias("vec_id"), integers(F.col(vector), scale).alias("x"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    size = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    nothing = spark.createDataFrame([], f"vec_id {kind}, {result}")
    if size is None or size["size"] == 0:
        return nothing
    rows = rows.where(F.size("x") == size["size"])
    fit = materialise(rows.select("x").distinct())
    model = train(fit, size["size"], components)
    if model is None:
        return nothing
    error, count = identity_error(fit, model), len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = model.centred(matrix(batch.column("x"), model.size))
            m = len(centred)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), count))), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                pa.array(np.full(m * count, model.n)), pa.array([d for d in model.deviations(centred) for _ in range(count)], pa.int64()),
                pa.array(model.project(centred).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * count, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, f"vec_id {kind}, {result}")
