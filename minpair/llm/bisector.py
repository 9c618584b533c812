"""Lloyd's rounds in integers, each vector's nearest centroid found by a tournament of bisectors.

For every pair of centroids ``i < j`` the integer normal ``2 (c_j - c_i)`` and the threshold
``|c_j|^2 - |c_i|^2`` are worked out once a round. A vector starts with centroid 0 as its champion; each
further centroid takes over if the vector's product with the pair's normal is above the threshold, and a
tie leaves the smaller number. After ``k - 1`` such tests the champion is the nearest centroid, and only
its distance is worked out, exactly.

Vectors are read anew in every round; each task sends its sums and counts by cluster and dimension, so
a cluster that holds most rows is added up before the shuffle, and ``k`` times the dimensions sums come to
the driver. Products are taken in doubles where every sum is a whole number that a double holds, else in
Python's integers.

Edge cases: vectors that are null, of another length, or hold null or non-finite components are dropped;
components beyond a long's range end there; null ids hash as the empty text; vectors whose ids repeat
start in the order of their components; fewer vectors than ``k`` give fewer centroids; equal centroids
leave the one with the larger number empty, and empty ones stay; distances beyond a long's range, and
sums with them, are null; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minpair.llm.whitening import EXACT, decimals, finite, integers, matrix, times
from minpair.session import materialise

SCALE = 64


@dataclass
class Bisectors:
    """Centroids (as Python's integers) with the normals and thresholds of all pairs: ``normals[j][i]`` for
    ``i < j``."""

    centroids: list[list[int]]

    def __post_init__(self) -> None:
        c = np.array(self.centroids, object)
        squares = (c * c).sum(axis=1)
        normals = [2 * (c[j] - c[:j]) for j in range(len(c))]
        thresholds = [squares[j] - squares[:j] for j in range(len(c))]
        self.most = max((abs(v) for row in self.centroids for v in row), default=0)
        # Smaller types where they hold every value.
        self.exact = np.float64 if 4 * self.most ** 2 * max(1, c.shape[1]) < EXACT else object
        self.normals = [n.astype(self.exact) for n in normals]
        self.thresholds = [t.astype(self.exact) for t in thresholds]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of every row, by ``k - 1`` sign tests."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        fits = self.exact is np.float64 and 4 * self.most * most * max(1, x.shape[1]) < EXACT
        x = x.astype(np.float64 if fits else object)
        champion = np.zeros(len(x), np.int32)
        for j in range(1, len(self.centroids)):
            side = (x * self.normals[j][champion]).sum(axis=1) - self.thresholds[j][champion]
            champion[(side > 0).astype(bool)] = j
        return champion

    def distances(self, x: np.ndarray, own: np.ndarray) -> list[int | None]:
        """Squared distance of every row to its centroid."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        small = x.shape[1] * (most + self.most) ** 2 < 2 ** 62
        off = x.astype(np.int64 if small else object) - np.array(self.centroids, np.int64 if small else object)[own]
        return [v if v < 2 ** 63 else None for v in (off * off).sum(axis=1).tolist()]


def start(rows: DataFrame, k: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of their id, in the order of the hashes."""
    tag = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["x"]) for r in rows.select("x", tag.alias("tag")).orderBy("tag", "x").limit(k).collect()]


def moved(rows: DataFrame, at: Bisectors, size: int) -> list[list[int]]:
    """Every centroid replaced by its vectors' floored mean."""
    k = len(at.centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), object)
        for batch in batches:
            x = matrix(batch.column("x"), size)
            own = at.nearest(x)
            counts += np.bincount(own, minlength=k)
            sums += times((own[None, :] == np.arange(k)[:, None]).astype(np.int64), x).astype(object)
        used = np.flatnonzero(counts)
        values = [v for c in used.tolist() for v in (int(counts[c]), *sums[c].tolist())]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(used, size + 1), pa.int32()), pa.array(list(range(-1, size)) * len(used), pa.int32()), decimals(values)],
            names=["cluster", "dim", "total"])

    sums = rows.select("x").mapInArrow(add, "cluster int, dim int, total decimal(38,0)").groupBy("cluster", "dim").agg(
        F.sum("total").alias("total")).collect()
    total = {(r["cluster"], r["dim"]): int(r["total"]) for r in sums}
    return [[total[c, d] // total[c, -1] for d in range(size)] if (c, -1) in total else old for c, old in enumerate(at.centroids)]


def cluster(vectors: DataFrame, size: int, k: int = 16, rounds: int = 3, scale: int = SCALE, vec_id: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector with
    ``size`` components."""
    spark = vectors.sparkSession
    rows = vectors.where(finite(F.col(vector)) & (F.size(vector) == size)).select(
        F.col(vec_id).alias("vec_id"), integers(F.col(vector), scale).alias("x"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    centroids = start(rows, k)
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    at = Bisectors(centroids)
    for _ in range(rounds):
        at = Bisectors(moved(rows, at, size))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), size)
            own = at.nearest(x)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own), pa.array(at.distances(x, own), pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    found = materialise(rows.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"))
    exact = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    by = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(exact.alias("s")).collect()}

    def as_long(value: int | None) -> int | None:
        return int(value) if value is not None and value < 2 ** 63 else None

    inertia = as_long(sum(by.values())) if None not in by.values() else None
    tags = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.centroids]
    lines = spark.createDataFrame([(c, as_long(s), inertia, tags[c]) for c, s in sorted(by.items())],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most k lines.
    return found.join(F.broadcast(lines), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
