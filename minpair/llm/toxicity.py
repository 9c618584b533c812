"""Toxicity from the nearest labelled examples.

Texts become TF-IDF vectors over all words of the labelled sample, and the examples of both labels are
searched. Plain idf buries the few words that carry the label under hundreds that do not, so the idf of
a word that is likelier in toxic examples is raised by the root of 1 + its chi-square; every other word
keeps its idf, and none is left out.

The index is inverted and in blocks: vectors are ordered by their heaviest word and cut into blocks of
``BLOCK``; a word's list is in runs, one for each block that has it, and each run has its largest weight.
The commonest words' runs are rows of a small matrix for each block. The largest weights of a text's words
add up to a bound for every block. The blocks with the highest bounds are read first; what they reach
for the k-th neighbour then decides which other blocks are read at all, each for those texts of a batch
whose bound passes. Sums are off by less than ``ROUNDING``; whatever reaches the k-th, less that, is
computed again in double precision, so the neighbours by cosine are exact. They vote by squared cosine,
and the vote is calibrated by the examples' own votes without themselves (isotonic regression over a
fixed number of bins). The neighbours are the evidence.

Training uses a bounded sample: at most about ``examples`` labelled texts of either label, selected
by a hash of the id; with them the index, which every worker gets, is bounded as well.

Edge cases: null and empty texts have no words and get the share of toxic examples among those
without words; ties in cosine go to the example with the smaller id; repeated rows are scored alike;
labels that are null or contradict each other for an id are left out; without examples of both
labels nothing is learnt and every score is the share of toxic examples (0 without any); an empty
table gives an empty table; input columns named like an output column are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minpair.llm.texts import chunks, fresh, sampled_labels, shield, with_columns
from minpair.session import materialise

EXAMPLES = 4_000
LONGEST = 24
NEIGHBOURS = 15
#: Vectors of a block, how many blocks are read before the others' bounds are looked at, and texts of a batch.
BLOCK, FIRST, TEXTS = 128, 4, 256
#: Terms in at least one of so many vectors, ``MOST_COMMON`` of them at most, are rows of the blocks' matrices.
COMMON, MOST_COMMON = 16, 1024
#: More than the sums of products of unit vectors can be off: the common part has at most ``MOST_COMMON``
#: float products and additions, each off by at most 2**-24 of a sum of sizes of at most 1 (Cauchy and
#: Schwarz); the factors, the other terms' weights (floats) and their products add a few roundings more.
ROUNDING = (MOST_COMMON + 8) * 2.0 ** -24
KNOWN_RUNS = 150_000
#: Characters of the texts that are scored at once.
STEP = 1_000_000
BINS = 64
WORD = re.compile(r"[^\W\d_]+")
#: Marks that often end a run; a run without other marks needs no pattern.
MARKS = frozenset(".,;:!?")


def run_terms(run: str) -> list[int]:
    """64-bit hashes of the words of letters in a run of lower-case characters, as often as they stand; a
    word over ``LONGEST`` characters counts by its beginning (marked by ``*``)."""
    if run.isalpha():
        words = [run]
    elif run[:-1].isalpha() and run[-1] in MARKS:
        words = [run[:-1]]
    else:
        words = WORD.findall(run)
    return [xxhash.xxh3_64_intdigest((w if len(w) <= LONGEST else w[:LONGEST] + "*").encode("utf-8", "surrogatepass")) for w in words]


def terms(text: str) -> np.ndarray:
    """Sorted hashes of the distinct terms of a text."""
    found = {t for run in set(text.lower().split()) for t in run_terms(run)}
    return np.sort(np.fromiter(found, np.uint64, len(found)).view(np.int64))


class _Finder:
    """Numbers of the vocabulary's terms in a text, ascending, and their counts. What a run of
    characters between white space has of them is kept (the number of a single word, -1 for one that the
    vocabulary lacks, or several numbers); a full cache is emptied."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.known: dict[str, int | tuple[int, ...]] = {}

    def _learn(self, runs: list[str]) -> None:
        own = [run_terms(r) for r in runs]
        hashes = np.array([t for x in own for t in x], np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(0, len(self.vocabulary) - 1))
        hit = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        found, place = np.where(hit, at, -1).tolist(), 0
        known = self.known
        for r, x in zip(runs, own, strict=True):
            if len(x) == 1:
                known[r] = found[place]
            else:
                known[r] = tuple(t for t in found[place:place + len(x)] if t >= 0)
            place += len(x)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        runs = Counter(text.lower().split())
        known = self.known
        new = runs.keys() - known.keys() if len(known) < len(runs) else [r for r in runs if r not in known]
        if len(known) + len(new) > KNOWN_RUNS:
            known.clear()
            new = runs.keys()
        if new:
            self._learn(list(new))
        out: dict[int, int] = {}
        for run, n in runs.items():
            t = known[run]
            if t.__class__ is int:
                if t >= 0:
                    out[t] = out.get(t, 0) + n
            else:
                for t in t:
                    out[t] = out.get(t, 0) + n
        return _arrays(out)


def _arrays(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    t = np.fromiter(counts.keys(), np.int32, len(counts))
    n = np.fromiter(counts.values(), np.int32, len(counts))
    order = np.argsort(t)
    return t[order], n[order]


def _spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all spans from ``lo`` up to ``hi``, one after the other."""
    n = hi - lo
    ends = np.cumsum(n)
    return np.repeat(lo - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Index:
    """Distinct vectors of the examples. ``members[v]``: the (id, label) that share vector v, smallest
    ids first; no more are kept than can be neighbours. ``term``, ``count``: the vectors' terms, cut at
    ``edge``, ``forward``: their weights. ``column[t]``: row of a common term in the blocks' matrices ``common`` and in ``common_most``, their
    largest weights by block, or -1. The other terms' lists: ``vectors`` and ``weights`` by term, in runs of
    one block each; ``start``, ``block`` and ``most`` of every run, a term's runs cut at ``cut``."""

    vocabulary: np.ndarray
    idf: np.ndarray
    members: list[list[tuple[int, int]]]
    term: np.ndarray
    count: np.ndarray
    edge: np.ndarray
    norm: np.ndarray | None = None
    forward: np.ndarray | None = None
    column: np.ndarray | None = None
    common: np.ndarray | None = None
    common_most: np.ndarray | None = None
    vectors: np.ndarray | None = None
    weights: np.ndarray | None = None
    start: np.ndarray | None = None
    block: np.ndarray | None = None
    most: np.ndarray | None = None
    cut: np.ndarray | None = None

    @classmethod
    def build(cls, vocabulary: np.ndarray, idf: np.ndarray, rows: Iterable[tuple]) -> Index:
        """``rows``: id, label and term counts, these as a dictionary or as the bytes of two arrays. Their
        bytes are let go one by one, as they are about as large as the index."""
        same: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
        for i, y, c in rows:
            key = tuple(x.tobytes() for x in _arrays(c)) if isinstance(c, dict) else c
            if key[0]:
                same.setdefault(key, []).append((i, y))
        def heaviest(key: tuple[bytes, bytes]) -> int:
            t, n = (np.frombuffer(b, np.int32) for b in key)
            return int(t[((1 + np.log(n)) * idf[t]).argmax()])

        # Vectors with the same heaviest term are neighbours, so that blocks are alike.
        packed = sorted(same, key=heaviest)
        members = [sorted(same[key])[:NEIGHBOURS + 1] for key in packed]
        same.clear()
        packed.reverse()
        edge = np.cumsum([0, *(len(t) // 4 for t, _ in packed[::-1])])
        highest = max((int(np.frombuffer(n, np.int32).max()) for _, n in packed), default=0)
        term, count = np.empty(edge[-1], np.int32), np.empty(edge[-1], np.uint16 if highest < 1 << 16 else np.int32)
        for v in range(len(members)):
            term[edge[v]:edge[v + 1]], count[edge[v]:edge[v + 1]] = (np.frombuffer(b, np.int32) for b in packed.pop())
        return cls(vocabulary, idf, members, term, count, edge)

    def __getstate__(self) -> dict:
        """What can't be worked out from the rest, compressed, as every executor keeps a file of it."""
        step, press = 1 << 20, zstandard.ZstdCompressor(level=3).compress
        return {"rest": (self.vocabulary, self.idf, self.members, self.edge, self.count.dtype), "parts": [
            tuple(press(x.view(np.uint8).reshape(len(x), -1).T.tobytes()) for x in (
                np.diff(self.term[lo:lo + step], prepend=np.int32(0)), self.count[lo:lo + step])) for lo in range(0, len(self.term), step)]}

    def __setstate__(self, state: dict) -> None:
        def back(part: bytes, kind: np.dtype) -> np.ndarray:
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(part), np.uint8)
            return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()

        vocabulary, idf, members, edge, kind = state["rest"]
        parts = state["parts"]
        term = np.concatenate([np.cumsum(back(t, np.int32), dtype=np.int32) for t, _ in parts]) if parts else np.empty(0, np.int32)
        count = np.concatenate([back(n, kind) for _, n in parts]) if parts else np.empty(0, kind)
        self.__init__(vocabulary, idf, members, term, count, edge)

    def _lay_out(self) -> None:
        """Matrices, lists and runs, some vectors at a time and in narrow types, as every worker has them."""
        many, blocks = len(self.members), max(1, -(-len(self.members) // BLOCK))
        often = np.bincount(self.term, minlength=len(self.idf))
        most = np.argsort(-often, kind="stable")[:MOST_COMMON]
        most = most[often[most] * COMMON >= max(COMMON, many)]
        del often
        self.column = np.full(len(self.idf), -1, np.int32)
        self.column[most] = np.arange(len(most))
        dense = np.zeros((blocks, len(most), BLOCK), np.float32)
        self.norm, self.forward = np.empty(many), np.empty(len(self.term))
        rare = np.empty(len(self.term), bool)
        for v in range(0, many, BLOCK):
            here = slice(self.edge[v], self.edge[min(many, v + BLOCK)])
            own = np.repeat(np.arange(min(many - v, BLOCK)), np.diff(self.edge[v:v + BLOCK + 1]))
            w = (1 + np.log(self.count[here], dtype=np.float64)) * self.idf[self.term[here]]
            self.norm[v:v + BLOCK] = np.sqrt(np.bincount(own, w * w))
            w /= self.norm[v + own]
            row = self.column[self.term[here]]
            dense[v // BLOCK, row[row >= 0], own[row >= 0]] = w[row >= 0]
            self.forward[here], rare[here] = w, row < 0
        self.common, self.common_most = dense, dense.max(axis=2, initial=0).T.copy()
        order = np.flatnonzero(rare).astype(np.int32)
        order = order[np.argsort(self.term[order], kind="stable")]
        self.vectors = np.repeat(np.arange(many, dtype=np.int32), np.diff(self.edge))[order]
        self.weights = self.forward[order].astype(np.float32)
        term, block = self.term[order], self.vectors // np.int32(BLOCK)
        del rare, order
        first = np.ones(len(term), bool)
        first[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(first).astype(np.int32)
        self.start = np.append(first, np.int32(len(term)))
        self.block = block[first]
        self.most = np.maximum.reduceat(self.weights, first) if len(first) else np.empty(0, np.float32)
        self.cut = np.concatenate([[0], np.cumsum(np.bincount(term[first], minlength=len(self.idf)))]).astype(np.int32)

    def vector(self, counts: dict[int, int] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t, n = _arrays(counts) if isinstance(counts, dict) else counts
        w = (1 + np.log(n)) * self.idf[t]
        return t, w / np.sqrt((w * w).sum())

    def nearest(self, counts: dict[int, int] | tuple[np.ndarray, np.ndarray], k: int = NEIGHBOURS, but: int | None = None
                ) -> list[tuple[float, int, float]]:
        """The ``k`` examples (``NEIGHBOURS`` at most) of largest cosine over 0 as (cosine, id, label),
        nearest first, ties by id; ``but``: id of an example to leave out."""
        return next(self.all_nearest([counts], k, [but]))

    def all_nearest(self, texts: list, k: int = NEIGHBOURS, but: list | None = None) -> Iterator[list[tuple[float, int, float]]]:
        """``nearest`` of many texts."""
        if self.norm is None:
            self._lay_out()
        dense = np.zeros(len(self.idf))
        for lo in range(0, len(texts), TEXTS):
            part = [self.vector(c) for c in texts[lo:lo + TEXTS]]
            about = self._about(part, k) if self.members else None
            for j, (t, w) in enumerate(part):
                if len(t) and about is not None:
                    yield self._exact(t, w, about[j], k, but[lo + j] if but else None, dense)
                else:
                    yield []

    def _about(self, part: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
        """Rounded cosines of texts (rows) with all vectors that can be among their ``k + 1`` nearest; the
        others have a part of their sum, or nothing."""
        many, blocks = len(self.members), len(self.common)
        asked = np.zeros((len(part), len(self.common_most)), np.float32)
        lists = []
        for row, (t, w) in zip(asked, part, strict=True):
            at = self.column[t]
            row[at[at >= 0]] = w[at >= 0]
            t, w = t[at < 0], w[at < 0]
            lists.append((_spans(self.cut[t], self.cut[t + 1]), np.repeat(w, self.cut[t + 1] - self.cut[t])))
        bound = (asked @ self.common_most).astype(np.float64)
        for row, (runs, w) in zip(bound, lists, strict=True):
            row += np.bincount(self.block[runs], self.most[runs] * w, blocks)
        about = np.zeros((len(part), blocks * BLOCK))
        if blocks > FIRST:
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, np.argpartition(-bound, FIRST - 1, axis=1)[:, :FIRST], True, axis=1)
        else:
            first = np.ones(bound.shape, bool)
        self._read(about, asked, lists, first)
        if blocks > FIRST:
            line = np.partition(about, about.shape[1] - k - 1, axis=1)[:, about.shape[1] - k - 1] if many > k + 1 else np.zeros(len(part))
            self._read(about, asked, lists, ~first & (bound >= line[:, None] - 2 * ROUNDING) & (bound > 0))
        return about[:, :many]

    def _read(self, about: np.ndarray, asked: np.ndarray, lists: list, which: np.ndarray) -> None:
        """Add the products of the chosen blocks (columns of ``which``), each for the texts that chose it."""
        for b in np.flatnonzero(which.any(axis=0)).tolist():
            rows = np.flatnonzero(which[:, b])
            about[rows, b * BLOCK:(b + 1) * BLOCK] += asked[rows] @ self.common[b]
        for row, chosen, (runs, w) in zip(about, which, lists, strict=True):
            here = chosen[self.block[runs]]
            runs, w = runs[here], w[here]
            at = _spans(self.start[runs], self.start[runs + 1])
            row += np.bincount(self.vectors[at], self.weights[at] * np.repeat(w, self.start[runs + 1] - self.start[runs]), about.shape[1])

    def _exact(self, t: np.ndarray, w: np.ndarray, about: np.ndarray, k: int, but: int | None, dense: np.ndarray
               ) -> list[tuple[float, int, float]]:
        # One more, as the nearest vector can have the left out example alone.
        line = np.partition(about, len(about) - k - 1)[len(about) - k - 1] - ROUNDING if len(about) > k + 1 else 0.0
        near = np.nonzero((about >= line) & (about > 0))[0]
        if not len(near):
            return []
        dense[t] = w
        sizes = self.edge[near + 1] - self.edge[near]
        own = np.repeat(self.edge[near] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        cosine = np.add.reduceat(self.forward[own] * dense[self.term[own]], np.cumsum(sizes) - sizes).round(12)
        dense[t] = 0
        order = np.argsort(-cosine, kind="stable")
        last = cosine[order[min(k, len(order) - 1)]]
        found = [(c, i, float(y)) for c, v in zip(cosine[order].tolist(), near[order].tolist(), strict=True) if c >= last
                 for i, y in self.members[v] if i != but]
        return sorted(found, key=lambda r: (-r[0], r[1]))[:k]


def vote(near: list[tuple[float, int, float]]) -> float:
    """Share of toxic examples among the neighbours, weighted by squared cosine; -1 without any."""
    weight = sum(c * c for c, _, _ in near)
    return sum(c * c * y for c, _, y in near) / weight if weight else -1.0


def isotonic(good: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing means of bins by pooling adjacent violators; empty bins take the pool before."""
    pools: list[list[float]] = []
    for g, w in zip(good.tolist(), weight.tolist(), strict=True):
        pools.append([g, w, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g, w, n = pools.pop()
            pools[-1] = [pools[-1][0] + g, pools[-1][1] + w, pools[-1][2] + n]
    return np.concatenate([np.full(int(n), g / w if w else 0.0) for g, w, n in pools])


@dataclass
class Model:
    """``index`` None: nothing was learnt. ``curve``: calibrated score of each bin of the vote.
    ``shared``: the index where the workers have it already."""

    index: Index | None
    prior: float
    none: float
    curve: np.ndarray
    shared: Broadcast | None = None

    def score(self, near: list[tuple[float, int, float]]) -> float:
        v = vote(near)
        return self.none if v < 0 else float(self.curve[min(BINS - 1, int(v * BINS))])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          examples: int = EXAMPLES) -> Model:
    """Model of the labelled rows of ``docs`` (labels 0 and 1)."""
    ids, total, share = sampled_labels(docs, labels, doc_id, label, {0: examples, 1: examples})
    prior = total.get(1, 0) / max(1, sum(total.values()))
    if len(total) < 2:
        return Model(None, prior, prior, np.zeros(BINS))
    # The sample is bounded, so its ids are broadcast and only its texts are moved.
    sample = materialise(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(ids), "_id").select(
        F.col("_id").alias("id"), F.col("_y").alias("y"), "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            own = [terms(t) for t in texts]
            keys, place = np.unique(np.concatenate(own), return_inverse=True)
            toxic = np.repeat(np.array(batch.column("y").to_pylist()), [len(x) for x in own]) == 1
            a, n = np.bincount(place[toxic], minlength=len(keys)), np.bincount(place, minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(a), pa.array(n - a)], names=["term", "a", "b"])

    seen = sample.groupBy("y").count().collect()
    many = {r["y"]: r["count"] for r in seen}
    pos, neg = many.get(1, 0), many.get(0, 0)
    if not pos or not neg:
        return Model(None, prior, prior, np.zeros(BINS))
    found = sample.select("y", "text").mapInArrow(count, "term long, a long, b long").groupBy("term").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    vocabulary, a, b = (found.column(c).to_numpy() for c in ("term", "a", "b"))
    order = np.argsort(vocabulary)
    vocabulary, a, b = vocabulary[order], a[order].astype(float), b[order].astype(float)
    del found, order
    n = pos + neg
    chi2 = n * (a * (neg - b) - b * (pos - a)) ** 2 / (float(pos * neg) * (a + b) * np.maximum(1, n - a - b))
    # Document frequency as in the whole, not as in the sample.
    idf = 1 + np.log((sum(total.values()) + 1) / (a / share[1] + b / share[0] + 1))
    idf *= np.sqrt(1 + np.where(a * neg > b * pos, chi2, 0.0))

    del a, b, chi2

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Finder(vocabulary)
        for batch, texts in chunks(batches, "text"):
            got = [find(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), *(
                pa.array([g[k].tobytes() for g in got], pa.binary()) for k in (0, 1))], names=["id", "y", "t", "n"])

    def unpacked(t: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(t, np.int32), np.frombuffer(n, np.int32)

    made = materialise(sample.select(F.col("id").cast("long"), "y", "text").mapInArrow(
        vectors, "id long, y int, t binary, n binary"))
    rows = ((r["id"], r["y"], (bytes(r["t"]), bytes(r["n"]))) for r in made.where(F.octet_length("t") > 0).toLocalIterator())
    index = Index.build(vocabulary, idf, rows)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def own_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [unpacked(t, n) for t, n in zip(*(batch.column(c).to_pylist() for c in ("t", "n")), strict=True)]
            bins = [vote(near) for near in shared.value.all_nearest(texts, but=batch.column("id").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([min(BINS - 1, int(v * BINS)) if v >= 0 else -1 for v in bins], pa.int32())], names=["y", "bin"])

    votes = made.mapInArrow(own_votes, "y int, bin int").groupBy("y", "bin").count().collect()
    good, weight, none = np.zeros(BINS), np.zeros(BINS), [0.0, 0.0]
    for r in votes:
        w = r["count"] / share[r["y"]]
        if r["bin"] < 0:
            none[0], none[1] = none[0] + w * r["y"], none[1] + w
        else:
            good[r["bin"]] += w * r["y"]
            weight[r["bin"]] += w
    return Model(index, prior, none[0] / none[1] if none[1] else prior, isotonic(good, weight), shared)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", evidence: str = "evidence") -> DataFrame:
    """All input columns but the text, with ``score`` and ``evidence``: the nearest examples' ids,
    cosines and labels."""
    docs, back = shield(fresh(docs, out, evidence), text)
    keep = [c for c in docs.columns if c != text]
    shape = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("cosine", T.DoubleType()),
                                      T.StructField("label", T.IntegerType())]))
    if model.index is None:
        return docs.select(*keep, F.lit(model.prior).alias(out), F.lit(None).cast(shape).alias(evidence)).withColumnsRenamed(back)
    shared = model.shared or docs.sparkSession.sparkContext.broadcast(model.index)
    bare = Model(None, model.prior, model.none, model.curve)
    arrow = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        find = _Finder(index.vocabulary)
        for batch, texts in chunks(batches, text, STEP):
            near = list(index.all_nearest([find(t) for t in texts]))
            yield with_columns(batch, keep, **{
                out: pa.array([bare.score(x) for x in near], pa.float64()),
                evidence: pa.array([[(i, c, int(y)) for c, i, y in x] for x in near], arrow)})

    return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, T.DoubleType()),
                                              T.StructField(evidence, shape)])).withColumnsRenamed(back)


def reject(docs: DataFrame, labels: DataFrame, threshold: float, doc_id: str = "doc_id", text: str = "text",
           label: str = "toxic") -> DataFrame:
    """The rows of ``docs`` with a score under ``threshold``, unchanged; learnt from all that are
    labelled."""
    model = train(docs, labels, doc_id, text, label)
    own = {c: f"toxicity_{uuid.uuid4().hex}_{c}" for c in ("text", "score", "near")}
    kept = score(docs.withColumn(own["text"], F.col(text)), model, own["text"], own["score"], own["near"])
    return kept.where(F.col(own["score"]) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
