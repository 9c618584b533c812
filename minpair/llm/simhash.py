"""SimHash near-duplicates through an inverted index over byte positions.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most three bits
share at least five of them. Posting lists of single bytes would have 256 keys a position and grow
with the square of the input, so a list is kept for a combination of four positional bytes: the 14
blocks below hold, for any three positions, a block that avoids them all, so every pair to find
meets in a list. Within a list the shared positional bytes of each pair are tallied, pairs with
fewer than five are dropped, and the rest are verified by their bit distance.

Only distinct fingerprints enter the index, so copies cost nothing. Lists longer than ``TILE`` are
dealt over tiles of pairs of sub-lists, each small enough for one task. A tile gives a spanning
forest of its links, which has the same components as all of them.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; texts under
``ngram`` words use their whole word sequence; repeated rows are all returned; a null id takes part
but is never a component's name unless the component has no other (then it is null); an empty table
gives an empty table; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minpair.llm.components import components
from minpair.llm.texts import chunks, fresh, shield, with_columns, words
from minpair.session import materialise

SEED = 42
#: Sets of four byte positions: positions as points of a cube, the sets that sum to zero. Any three
#: positions lie in one set, and the other half of the cube is a set too.
BLOCKS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
MOST_BITS, LEAST_SHARED = 3, 5
TILE = 1024
LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if more than half of the hashes have it. A lane of a word counts one bit
    of each byte; lanes are added up in runs of 255 so that none overflows."""
    starts = np.arange(0, len(hashes), 255)
    counts = np.empty((8, 8), np.int64)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & LANES, starts)
        counts[:, k] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (2 * counts.reshape(64) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, ngram: int = 3) -> int:
    ws = words(text)
    if not ws:
        return 0
    shingles = (list(map(b" ".join, zip(*(ws[i:] for i in range(ngram)), strict=False)))
                if len(ws) >= ngram else [b" ".join(ws)])
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)))


def fingerprints(docs: DataFrame, text: str = "text", ngram: int = 3, out: str = "fp") -> DataFrame:
    """All input columns but the text, and the fingerprint as a signed 64-bit integer."""
    docs = fresh(docs, out)
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text):
            fps = np.array([fingerprint(t, ngram) for t in texts], np.uint64).view(np.int64)
            yield with_columns(batch, keep, **{out: pa.array(fps)})

    fields = [docs.schema[c] for c in keep]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.LongType())]))


def _posting_keys() -> F.Column:
    """For each block its number and its four bytes; two numbers so that no bits are lost."""
    def key(n: int, block: tuple[int, ...]) -> F.Column:
        value = F.lit(0).cast("long")
        for place, byte in enumerate(block):
            value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", 8 * byte).bitwiseAND(F.lit(255)), 8 * place))
        return value.bitwiseOR(F.lit(n << 32).cast("long"))
    return F.array(*[key(n, b) for n, b in enumerate(BLOCKS)])


def _forest(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest among the fingerprints of one tile."""
    parent = list(range(len(fps)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at in range(0, len(fps), 256):
        diff = fps[at:at + 256, None] ^ fps[None, :]
        shared = sum(((diff >> np.uint64(8 * k)) & np.uint64(255) == 0).astype(np.int8) for k in range(8))
        i, j = np.nonzero(shared >= LEAST_SHARED)
        i, j = i[i + at < j], j[i + at < j]
        close = np.bitwise_count(diff[i, j]) <= MOST_BITS
        for x, y in zip((i[close] + at).tolist(), j[close].tolist(), strict=True):
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[rx] = ry
                yield x, y


def links(nodes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints in ``fp`` that differ in at most three bits,
    enough of them to join every component."""
    keyed = nodes.select("fp", F.explode(_posting_keys()).alias("key"))
    lists = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    many = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    dealt = (keyed.join(lists, "key").select("fp", "key", many.alias("many"))
             .withColumn("own", F.pmod(F.xxhash64("fp", "key"), F.col("many")).cast("int"))
             .select("fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("other")))
    tiles = dealt.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, found = batch.column("fps"), []
            values, offsets = col.values.to_numpy().view(np.uint64), col.offsets.to_numpy()
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                fps = values[lo:hi]
                if hi - lo == 2:
                    if int(fps[0] ^ fps[1]).bit_count() <= MOST_BITS:
                        found.append((fps[0], fps[1]))
                else:
                    fps = np.unique(fps)
                    found += [(fps[x], fps[y]) for x, y in _forest(fps)]
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return tiles.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ngram: int = 3) -> DataFrame:
    """All input columns but the text, with ``fp`` (signed) and ``component_id``."""
    docs, back = shield(fresh(docs, "fp", "component_id"), doc_id, text)
    return rooted(docs, doc_id, text, ngram).drop("_root").withColumnsRenamed(back)


def rooted(docs: DataFrame, doc_id: str, text: str, ngram: int) -> DataFrame:
    """``near_duplicates`` with ``_root``, a fingerprint of the component that no other has; two components
    share a ``component_id`` where an id stands on rows of both."""
    marked = materialise(fingerprints(fresh(docs, "component_id"), text, ngram))
    nodes = marked.groupBy("fp").agg(F.min(doc_id).alias("least"))
    roots = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    named = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(names, "root").select("fp", "component_id", F.col("root").alias("_root")), "fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ngram: int = 3) -> DataFrame:
    """One row of each component, unchanged: the one with the smallest id (a null id last, equal
    ids by the text's hash; of rows that are alike in both any one)."""
    docs, back = shield(docs, doc_id, text)
    rows = docs.withColumn("_id", F.col(doc_id)).withColumn("_t", F.xxhash64(text))
    group = rooted(rows.select("_id", "_t", F.col(text).alias("_x")), "_id", "_x", ngram)
    best = group.groupBy("_root").agg(
        F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_t")).alias("best"))
    best = best.select(F.col("best._id").alias("k_id"), F.col("best._t").alias("k_t"))
    return (rows.join(best, F.col("_id").eqNullSafe(F.col("k_id")) & (F.col("_t") == F.col("k_t")), "left_semi")
            .dropDuplicates(["_id", "_t"]).select(*docs.columns).withColumnsRenamed(back))
