"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

Both halves of the vectors are quantised by their own centroids, and a row's cell is the pair of its
nearest ones. A query walks the pairs from the best sum of both halves' products downward, with a
heap over the two sorted lists, until the cells passed hold enough entries; those entries are then
ranked by the exact product in double precision. How many are enough is measured when the centroids
are trained: the smallest share of a bounded sample for which the sample's own queries find ``recall``
of their true neighbours. (Neighbours of a larger table are closer, so the share errs on the safe
side.)

Cells travel as blocks: entries of one first centroid, split by a hash of the id into parts of about
``PART`` rows, meet blocks of about ``QUERY_BLOCK`` queries, and each meeting hands on the ``k`` best
of each query only.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with
a null id, take no part, nor do vectors of another length than the sample's most frequent; of rows
that repeat an id the one with the smallest vector counts; equal products are ranked by id; an empty
table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from minpair.session import materialise

SAMPLE = 12_000
CENTROIDS = 64
PART, QUERY_BLOCK = 3_000, 1_500
SHARES = (0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9, 1.0)
RESULT = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _centroids(points: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from evenly spread starting rows; an empty cell keeps its centroid."""
    c = points[np.linspace(0, len(points) - 1, min(count, len(points))).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(points, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * points @ c.T).argmin(axis=1)


@dataclass
class MultiIndex:
    """Centroids of the first ``cut`` components and of the others; ``share`` of all entries that a
    query has to pass."""

    size: int
    cut: int
    first: np.ndarray
    second: np.ndarray
    share: float = 1.0

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(x[:, :self.cut], self.first), _nearest(x[:, self.cut:], self.second)

    def walk(self, query: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """Cells with entries, best sum of products first, until they hold ``enough`` entries."""
        a, b = self.first @ query[:self.cut], self.second @ query[self.cut:]
        oa, ob = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        sa, sb = (-a[oa]).tolist(), (-b[ob]).tolist()
        la, lb = oa.tolist(), ob.tolist()
        heap, out, passed = [(sa[0] + sb[0], 0, 0)], [], 0
        while heap and passed < enough:
            _, i, j = heapq.heappop(heap)
            # (i, j + 1) follows (i, j); (i + 1, 0) follows (i, 0): every pair enters once.
            if j + 1 < len(sb):
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(sa):
                heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
            n = counts[la[i]][lb[j]]
            if n:
                out.append((la[i], lb[j]))
                passed += n
        return out


def train(sample: np.ndarray, k: int, recall: float, centroids: int = CENTROIDS) -> MultiIndex:
    """Centroids of the sample, and the share for which up to 200 of its rows as queries find
    ``recall`` of their ``k`` nearest other rows."""
    cut = sample.shape[1] // 2
    index = MultiIndex(sample.shape[1], cut, _centroids(sample[:, :cut], centroids), _centroids(sample[:, cut:], centroids))
    queries = np.unique(np.linspace(0, len(sample) - 1, min(200, len(sample))).astype(int))
    i, j = index.cells(sample)
    cell = i * len(index.second) + j
    counts = np.bincount(cell, minlength=len(index.first) * len(index.second))
    reached = []
    for q in queries:
        x = sample[q]
        scores = sample @ x
        scores[q] = -np.inf
        best = np.argsort(-scores, kind="stable")[:min(k, len(sample) - 1)]
        order = np.argsort(-((index.first @ x[:cut])[:, None] + (index.second @ x[cut:])[None, :]).ravel(), kind="stable")
        before = np.empty(len(order))
        before[order] = np.cumsum(counts[order]) - counts[order]
        reached.append(before[cell[best]] / len(sample))  # passed before the neighbour's cell
    reached = np.concatenate(reached) if reached else np.zeros(0)
    index.share = next((s for s in SHARES if not len(reached) or (reached < s).mean() >= recall), 1.0)
    return index


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _best(queries: pa.Table, entries: pa.Table, size: int, k: int, cells: int) -> pa.Table:
    """The ``k`` best entries of each query among the cells that it walks in this block."""
    entries = entries.sort_by("vec_id")
    x, q = _matrix(entries["vector"], size), _matrix(queries["vector"], size)
    ids, second = entries["vec_id"].to_numpy(), entries["second"].to_numpy()
    # Equal vectors of a cell are ranked once and stand for all their ids.
    rows = np.ascontiguousarray(np.column_stack([x, second]))
    _, first, group = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(),
                                return_index=True, return_inverse=True)
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])
    open_ = np.zeros((len(q), cells), bool)
    walked = queries["seconds"].combine_chunks()
    open_[np.repeat(np.arange(len(q)), np.diff(walked.offsets.to_numpy())), walked.flatten().to_numpy()] = True
    scores = np.where(open_[:, second[first]], q @ x[first].T, -np.inf)
    own = queries["query_id"].to_numpy()
    few = min(k + 1, scores.shape[1])  # one more, as the query itself may be among them
    top = np.argpartition(-scores, few - 1, axis=1)[:, :few]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for r in range(len(q)):
        take = [members[g][:k + 1] for g in top[r].tolist() if scores[r, g] > -np.inf]
        if not take:
            continue
        at = np.concatenate(take)
        at = at[ids[at] != own[r]]
        exact = (x[at] * q[r]).sum(axis=1)
        order = np.lexsort((ids[at], -exact))[:k]
        out.append((np.full(len(order), own[r]), ids[at][order], exact[order]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
    return pa.table(cols, names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.95, vec_id: str = "vec_id",
           vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query`` marks its ``k`` nearest
    other rows. ``sample``: rows that the index is trained on."""
    spark = vectors.sparkSession
    chosen = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"),
        is_query.alias("is_query"))
    rows = materialise(chosen.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("is_query").alias("is_query")))
    total = rows.count()
    share = min(1.0, sample / max(1, total))
    place = F.xxhash64("vec_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    drawn = rows.where(place < share).orderBy("vec_id").limit(2 * sample).select("vector").toPandas()["vector"]
    if not len(drawn):
        drawn = rows.limit(1).toPandas()["vector"]
    if not len(drawn):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = drawn.map(len)
    size = int(sizes.mode().iloc[0])
    index = train(np.stack(drawn[sizes == size].tolist()).astype(np.float64), k, recall)
    shared = spark.sparkContext.broadcast(index)
    rows = rows.where(F.size("vector") == size)
    cells = len(index.second)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                i, j = shared.value.cells(_matrix(batch.column("vector"), size))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), batch.column("is_query"),
                                                  pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))],
                                                 names=["vec_id", "vector", "is_query", "first", "second"])

    entries = materialise(rows.mapInArrow(assign, "vec_id long, vector array<double>, is_query boolean, first int, second int"))
    counts = np.zeros((len(index.first), cells), np.int64)
    for r in entries.groupBy("first", "second").count().collect():  # at most CENTROIDS squared
        counts[r["first"], r["second"]] = r["count"]
    n, queries = int(counts.sum()), entries.where("is_query").count()
    enough = max(int(np.ceil(index.share * n)), 2 * k)
    parts = np.maximum(1, -(-counts.sum(axis=1) // PART)).tolist()
    blocks = max(1, -(-queries // QUERY_BLOCK))
    table = spark.sparkContext.broadcast(counts.tolist())

    def walk(batches):
        for batch in batches:
            out = {c: [] for c in ("query_id", "vector", "first", "seconds", "part")}
            ids = batch.column("vec_id").to_pylist()
            if not ids:
                continue
            for i, x in zip(ids, _matrix(batch.column("vector"), size), strict=True):
                by: dict[int, list[int]] = {}
                for a, b in shared.value.walk(x, table.value, enough):
                    by.setdefault(a, []).append(b)
                for a, seconds in by.items():
                    for part in range(parts[a]):
                        for c, v in zip(out, (i, x, a, seconds, part), strict=True):
                            out[c].append(v)
            yield pa.RecordBatch.from_arrays([
                pa.array(out["query_id"], pa.int64()), pa.array(out["vector"], pa.list_(pa.float64())), pa.array(out["first"], pa.int32()),
                pa.array(out["seconds"], pa.list_(pa.int32())), pa.array(out["part"], pa.int32())], names=list(out))

    walks = entries.where("is_query").select("vec_id", "vector").mapInArrow(
        walk, "query_id long, vector array<double>, first int, seconds array<int>, part int"
    ).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    many = F.element_at(F.array(*[F.lit(p) for p in parts]), F.col("first") + 1)
    dealt = entries.select("vec_id", "vector", "first", "second", F.pmod(F.xxhash64("vec_id"), many).cast("int").alias("part"),
                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ["first", "part", "block"]
    found = walks.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(
        lambda a, b: _best(a, b, size, k, cells) if a.num_rows and b.num_rows else
        pa.table([np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], names=["query_id", "vec_id", "score"]), RESULT)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
