"""Language model scoring with quantised counts in a log-frequency Bloom filter.

The model is a word bigram with Witten-Bell smoothing. Its counts are quantised to powers of
``BASE``; a count of level q stands in the filter as q + 1 entries (key, 0) .. (key, q), and is read
by asking for one level after the other until one is missing. For a word w after v

    P(w | v) = (c(vw) + E(v) P(w)) / T(v),   P(w) = c(w) / (N + U),   P(unknown) = U / (N + U)

with N training tokens, U words seen once, T(v) = c(v) + the number of different followers of v, and
E(v) = T(v) less the bigram counts that the filter keeps. The filter keeps all words and all bigrams
that training text has, at every size. A word without kept bigrams leaves P(w).

The texts are read and tokenised once, into chunks of word numbers. From them every chunk sends each
shard of the word hashes its words and bigrams, sorted and compressed, those of texts to score among
them; a shard adds up the counts of all chunks, builds its segment of the filter, and answers each
chunk with the exact counts of its words and with what the segment has of its words and bigrams. So
no worker holds more than a segment, and the filter grows with the input: there are as many segments
as half the chunks. The chunks are then scored with the answers. Only if ``filter_bytes`` is given do
segments share so many bytes, and bigrams under the least count that fits leave their mass to E(v).

Edge cases: a null text counts as empty and has the end token only; texts that are shorter or longer
than a chunk are treated alike; repeated rows count as often as they stand; without training text
every score is 0; an empty table gives an empty table; input columns named like an output column are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from minpair.llm.texts import chunks, fresh, hash_words, private, shield, words
from minpair.session import materialise

CHUNK = 8_000_000
BASE = 1.5
BITS_PER_ENTRY, HASHES = 10, 7
END = np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of entries: count of a word, of a bigram, T and E of a context.
WORD, PAIR, TOTAL, ESCAPE = (np.uint64(k) for k in (11, 23, 37, 53))
ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """Integers as compressed bytes: differences if ascending, then all lowest bytes first."""
    x = x.astype(np.uint64)
    if ascending and len(x):
        x = np.diff(x, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(b: bytes, ascending: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    x = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if ascending else x


def mix(*parts) -> np.ndarray:
    """64-bit mixture of numbers (multiply, shift, add)."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ (p + MIX + (h << np.uint64(6)))) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(33)
    return h


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the leading bits, so that sorted keys fall into runs."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


class Segment:
    """A Bloom filter of (key, level) entries."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First place and step of each entry; its places follow by double hashing."""
        h = mix(keys, np.uint64(level))
        return h, mix(h, np.uint64(3)) | np.uint64(1)

    @classmethod
    def build(cls, keys: np.ndarray, levels: np.ndarray) -> bytes:
        size = max(64, int((levels + 1).sum()) * BITS_PER_ENTRY)
        bits = np.zeros(-(-size // 8), np.uint8)
        level = 0
        while len(keys):
            h, step = cls.hashes(keys, level)
            for _ in range(HASHES):
                at = h % np.uint64(8 * len(bits))
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
                h = h + step
            level += 1
            keys, levels = keys[levels >= level], levels[levels >= level]
        return bits.tobytes()

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        """Whether all places of the entries are set; entries with an empty place are dropped at once."""
        h, step = self.hashes(keys, level)
        found = np.arange(len(keys))
        for _ in range(HASHES):
            at = h % np.uint64(8 * len(self.bits))
            ok = self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
            found, step = found[ok], step[ok]
            h = h[ok] + step
            if not len(found):
                break
        out = np.zeros(len(keys), bool)
        out[found] = True
        return out


class Filter:
    """All segments; a key belongs to the segment of the word that it is about (a bigram: its
    context)."""

    def __init__(self, segments: dict[int, bytes], shards: int):
        self.segments = {s: Segment(np.frombuffer(b, np.uint8)) for s, b in segments.items()}
        self.shards = shards

    def counts(self, shard: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Quantised counts, 0 where not even the lowest level is there. Keys sorted by shard."""
        out = np.zeros(len(keys))
        edges = np.searchsorted(shard, np.arange(self.shards + 1, dtype=np.uint64))
        for s, segment in self.segments.items():
            rest = np.arange(edges[s], edges[s + 1])
            level = 0
            while len(rest):
                rest = rest[segment.has(keys[rest], level)]
                out[rest] = BASE ** level
                level += 1
        return out


def levels(counts: np.ndarray) -> np.ndarray:
    return np.rint(np.log(np.maximum(counts, 1)) / np.log(BASE)).astype(np.int64)


def tokenised(docs: DataFrame, text: str, train: str) -> DataFrame:
    """One row a chunk: number, the other columns of its rows, the tokens of each row, which rows
    train, the sorted distinct words and every token's number among them."""
    keep = [c for c in docs.columns if c not in (text, train)]
    rows = docs.select(*keep, text, F.coalesce(train, F.lit(False)).alias(train))
    row_type = T.StructType([docs.schema[c] for c in keep])
    arrow_rows = to_arrow_type(row_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch, texts in chunks(batches, text, CHUNK):
            ws, lengths = [], []
            for t in texts:
                own = words(t)
                ws += own
                lengths.append(len(own) + 1)
            edge = np.cumsum(lengths)
            tokens = np.full(edge[-1], END, np.uint64)
            inner = np.ones(len(tokens), bool)
            inner[edge - 1] = False
            tokens[inner] = hash_words(ws)
            keys, place = np.unique(tokens, return_inverse=True)
            members = pa.StructArray.from_arrays([batch.column(c) for c in keep], fields=list(arrow_rows))
            listed = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), members)
            trains = np.array(batch.column(train).to_pylist(), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number], pa.int64()), listed,
                 *(pa.array([b], pa.binary()) for b in (pack(np.array(lengths)), trains.tobytes(), pack(keys, True), pack(place)))],
                names=["chunk", "rows", "lengths", "trains", "keys", "tokens"])
            number += 1

    shape = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("rows", T.ArrayType(row_type)),
                          *(T.StructField(c, T.BinaryType()) for c in ("lengths", "trains", "keys", "tokens"))])
    return materialise(rows.mapInArrow(run, shape))


def _before(tokens: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The token before each one; the end token before the first of a text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    if len(tokens):
        out[np.cumsum(lengths) - lengths] = end
    return out


def _follower(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(7)) & np.uint64(0xFFFFFFFF)


def _codes(tokens: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each token the number of the word before it and 32 bits of its own hash."""
    context = _before(tokens, lengths, int(np.searchsorted(keys, END)))
    return context.astype(np.uint64) << np.uint64(32) | _follower(keys)[tokens]


def _sent(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """What each chunk tells each shard: its words with their training counts, and for each word as
    a context its followers (32 bits of their hash) with training counts, 0 if they are only to score."""
    for batch in batches:
        for r in batch.select(["chunk", "lengths", "trains", "keys", "tokens"]).to_pylist():
            lengths, keys, tokens = unpack(r["lengths"]).astype(np.int64), unpack(r["keys"], True), unpack(r["tokens"]).astype(np.int64)
            train = np.repeat(np.frombuffer(r["trains"], np.uint8) == 1, lengths)
            count = np.bincount(tokens[train], minlength=len(keys))
            codes = _codes(tokens, lengths, keys)
            pairs, place = np.unique(codes, return_inverse=True)
            n = np.bincount(place[train], minlength=len(pairs))
            owner = (pairs >> np.uint64(32)).astype(np.int64)
            kinds = np.bincount(owner, minlength=len(keys))
            edge = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1, dtype=np.uint64))
            pair_edge = np.searchsorted(owner, edge)
            out = [(s, r["chunk"], pack(keys[a:b], True), pack(count[a:b]), pack(kinds[a:b]),
                    pack(pairs[c:d] & np.uint64(0xFFFFFFFF)), pack(n[c:d]))
                   for s, (a, b, c, d) in enumerate(zip(edge[:-1], edge[1:], pair_edge[:-1], pair_edge[1:], strict=True)) if a < b]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])],
                names=["shard", "chunk", "keys", "counts", "kinds", "followers", "pair_counts"])


SENT = "shard int, chunk long, keys binary, counts binary, kinds binary, followers binary, pair_counts binary"
#: The places of a chunk's words, as such and as contexts, and of its bigrams in the filter are levels
#: plus 1, or 0 if they are not there.
FOUND = ("word", "total", "escape", "pair")
ANSWER = "shard int, chunk long, counts binary, " + ", ".join(f"{c} binary" for c in FOUND) + ", tokens long, distinct long, once long, size long"


def _answered(table: pa.Table, share: int | None) -> pa.Table:
    """One shard: an answer for each chunk (exact counts of its words, and what the shard's segment of
    the filter has of its words and bigrams), and a row with the shard's totals."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    shard = rows[0]["shard"]
    own = [unpack(r["keys"], True) for r in rows]
    keys, place = np.unique(np.concatenate(own), return_inverse=True)
    count = np.bincount(place, np.concatenate([unpack(r["counts"]) for r in rows]), len(keys)).astype(np.int64)
    context = np.concatenate([np.repeat(p, unpack(r["kinds"]).astype(np.int64)) for p, r in zip(
        np.split(place, np.cumsum([len(k) for k in own])[:-1]), rows, strict=True)]).astype(np.uint64)
    pairs, at = np.unique(context << np.uint64(32) | np.concatenate([unpack(r["followers"]) for r in rows]), return_inverse=True)
    n = np.bincount(at, np.concatenate([unpack(r["pair_counts"]) for r in rows]), len(pairs)).astype(np.int64)
    del context
    owner = (pairs >> np.uint64(32)).astype(np.int64)
    total = count + np.bincount(owner[n > 0], minlength=len(keys))
    known = count > 0
    least = 1
    while True:
        kept = n >= least
        held = np.bincount(owner[kept], n[kept], len(keys)).astype(np.int64)
        ctx = held > 0
        entry = np.concatenate([mix(WORD, keys[known]), mix(PAIR, keys[owner[kept]], pairs[kept] & np.uint64(0xFFFFFFFF)),
                                mix(TOTAL, keys[ctx]), mix(ESCAPE, keys[ctx])])
        level = levels(np.concatenate([count[known], n[kept], total[ctx], (total - held)[ctx]]))
        if share is None or (level + 1).sum() * BITS_PER_ENTRY <= 8 * share or not kept.any():
            break
        least *= 2
    segment = Segment.build(entry, level)
    model = Filter({0: segment}, 1)

    def found(asked: np.ndarray) -> np.ndarray:
        got = model.counts(np.zeros(len(asked), np.uint64), asked)
        return np.where(got > 0, levels(got) + 1, 0)

    words_ = [found(mix(kind, keys)) for kind in (WORD, TOTAL, ESCAPE)]
    pair = found(mix(PAIR, keys[owner], pairs & np.uint64(0xFFFFFFFF)))
    cut = np.cumsum([len(k) for k in own])[:-1]
    pair_cut = np.cumsum([int(unpack(r["kinds"]).sum()) for r in rows])[:-1]
    out = [(shard, r["chunk"], pack(count[p]), *(pack(x[p]) for x in words_), pack(pair[q]), 0, 0, 0, 0)
           for r, p, q in zip(rows, np.split(place, cut), np.split(at, pair_cut), strict=True)]
    out.append((shard, *[None] * 6, int(count.sum()), int(known.sum()), int((count == 1).sum()), len(segment)))
    cols = list(zip(*out, strict=True))
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 5, *[pa.int64()] * 4]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                names=["shard", "chunk", "counts", *FOUND, "tokens", "distinct", "once", "size"])


def _scored(chunk: pa.Table, answers: pa.Table, total: int, distinct: int, once: int) -> pa.Table:
    """The rows of one chunk with their scores."""
    r = chunk.select(["lengths", "keys", "tokens"]).to_pylist()[0]
    lengths, keys, tokens = unpack(r["lengths"]).astype(np.int64), unpack(r["keys"], True), unpack(r["tokens"]).astype(np.int64)
    start = np.cumsum(lengths) - lengths
    told = sorted(answers.to_pylist(), key=lambda a: a["shard"])
    count = np.concatenate([unpack(a["counts"]) for a in told])
    level = [np.concatenate([unpack(a[c]) for a in told]).astype(np.int64) for c in FOUND]
    found, all_, escape, pair_count = (np.where(x > 0, BASE ** (x - 1.0), 0.0) for x in level)
    base = np.log10(count + 0.1)
    base_score = np.add.reduceat(base[tokens], start) - lengths * np.log10(total + 0.1 * (distinct + 1))

    unseen = max(once, 1)
    alone = np.where(found > 0, found, unseen) / (total + unseen)
    known_context = (all_ > 0) & (escape > 0)
    context = _before(tokens, lengths, int(np.searchsorted(keys, END)))
    pair, place = np.unique(context.astype(np.int64) * len(keys) + tokens, return_inverse=True)
    v, w = pair // len(keys), pair % len(keys)
    # Two followers of a word can share the 32 bits, so there may be fewer codes than pairs.
    code = v.astype(np.uint64) << np.uint64(32) | _follower(keys)[w]
    together = pair_count[np.unique(code, return_inverse=True)[1]]
    # Quantised parts can add up to more than the whole; a probability never does.
    p = np.where(known_context[v], np.minimum(1.0, (together + escape[v] * alone[w]) / np.maximum(all_[v], 1)), alone[w])
    score = np.add.reduceat(np.log10(p)[place], start)
    rows = chunk["rows"].combine_chunks().flatten()
    names = [f.name for f in rows.type]
    return pa.Table.from_arrays(
        [*rows.flatten(), pa.array(lengths), pa.array(np.add.reduceat((count > 0)[tokens].astype(np.int64), start)),
         pa.array(np.full(len(lengths), total, np.int64)), pa.array(base_score), pa.array(score)], names=[*names, *ADDED])


def score(docs: DataFrame, train: Column, text: str = "text", filter_bytes: int | None = None) -> DataFrame:
    """All input columns but the text, with ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-a-tenth unigram) and ``score``, log10 probabilities. ``train`` marks the rows
    to learn from; ``filter_bytes`` bounds the whole filter, None leaves it as large as the counts
    need."""
    mark, = private("train")
    docs, back = shield(fresh(docs.withColumn(mark, train), *ADDED), text, mark)
    table = tokenised(docs, text, mark)
    keep = [c for c in docs.columns if c not in (text, mark)]
    shards = max(1, -(-table.count() // 2))
    share = None if filter_bytes is None else max(1, filter_bytes // shards)
    sent = table.mapInArrow(lambda b: _sent(b, shards), SENT)
    answers = materialise(sent.repartition(shards, "shard").groupBy("shard").applyInArrow(lambda t: _answered(t, share), ANSWER))
    sums = answers.where("chunk is null").agg(*(F.sum(c).alias(c) for c in ("tokens", "distinct", "once", "size"))).first()
    if filter_bytes is not None and (sums["size"] or 0) > 2 * filter_bytes:
        raise ValueError(f"the words alone take {sums['size']} bytes of filter; raise filter_bytes")
    n, v, u = sums["tokens"] or 0, sums["distinct"] or 0, sums["once"] or 0

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return _scored(a, b, n, v, u)

    shape = T.StructType([*[docs.schema[c] for c in keep], *(T.StructField(c, T.LongType()) for c in ADDED[:3]),
                          *(T.StructField(c, T.DoubleType()) for c in ADDED[3:])])
    replies = answers.where("chunk is not null").select("chunk", "shard", "counts", *FOUND)
    return table.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, shape).withColumnsRenamed(back)
