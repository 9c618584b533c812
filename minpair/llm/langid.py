"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts up to ``ORDER`` bytes, whose statistics are frozen after
training. A byte costs its code length in the longest context known to the language; where the
context has not seen the byte, the escape probability (distinct followers over total plus distinct)
is paid and the next shorter context is asked, down to the uniform distribution. The language with
the shortest code for the whole text is predicted; the score is its probability when all languages
are equally likely beforehand.

The trees come from a sample of pieces of distinct texts, about ``train_bytes`` bytes for each language,
that a hash of the text and the piece's number selects; a byte keeps the context before its piece.
Pieces are short beside ``train_bytes``, so however a language's bytes lie in its texts, it is learnt,
and has about ``train_bytes`` nodes an order at most. There can be any number of languages: ``TOGETHER``
at a time are brought to the driver and laid out in a table of costs of their own, so what goes to the
workers grows in step with the number of languages, whatever the input's size.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is every text when
nothing was learnt; ties go to the first language in code point order; texts of any length are scored
whole; repeated rows get equal results and are learnt once; rows without a language teach nothing; an
empty table gives an empty table; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minpair.llm.texts import chunks, fresh, shield, with_columns
from minpair.session import materialise

ORDER = 4
TRAIN_BYTES = 1_500_000
#: Bytes of a piece; with small ``train_bytes`` less, so that many pieces make them up.
PIECE, LEAST_PIECES = 2048, 512
#: Languages whose trees share a table of costs, which has a cell for every node and language.
TOGETHER = 4
LETTER = regex.compile(r"\p{L}")


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts, it and the ``order`` bytes before it as one integer (zeros before
    the start), and the place where each text starts. Empty texts count as one zero byte."""
    pad = bytes(order)
    return windows([pad + (t.encode("utf-8", "surrogatepass") or b"\0") for t in texts], order)


def windows(parts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The same for parts that begin with ``order`` bytes of context."""
    lengths = np.array([len(b) - order for b in parts], np.int64)
    raw = np.frombuffer(b"".join(parts), np.uint8)
    packed = np.zeros(len(raw) - order, np.int64)
    for k in range(order + 1):
        packed = (packed << 8) | raw[k:len(raw) - order + k]
    # Windows that end in a later part's context are dropped.
    keep = np.repeat(np.arange(len(parts)) * order, lengths) + np.arange(lengths.sum())
    return packed[keep], np.cumsum(lengths) - lengths


@dataclass
class Trees:
    """Union of the languages' context trees. For order k: sorted grams with the code length of the
    last byte in every language, and sorted contexts with the escape cost (0 if unknown)."""

    languages: list[str]
    gram: list[np.ndarray]
    cost: list[np.ndarray]
    context: list[np.ndarray]
    escape: list[np.ndarray]

    @classmethod
    def learn(cls, languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Trees:
        """``counts``: grams of ``ORDER + 1`` bytes and how often each language has them."""
        out = cls(languages, [], [], [], [])
        below = np.full((1, len(languages)), 8.0, np.float32)  # uniform over bytes
        for k in range(ORDER + 1):
            mask = (1 << 8 * (k + 1)) - 1
            own = {}
            for g in languages:
                packed, n = counts[g]
                keys, place = np.unique(packed & mask, return_inverse=True)
                own[g] = keys, np.bincount(place, weights=n, minlength=len(keys))
            gram = np.unique(np.concatenate([own[g][0] for g in languages]))
            context = np.unique(gram >> 8)
            escape = np.zeros((len(context), len(languages)), np.float32)
            shorter = np.zeros(len(gram), np.int64) if k == 0 else np.searchsorted(out.gram[-1], gram & (mask >> 8))
            where = np.searchsorted(context, gram >> 8)
            cost = np.empty((len(gram), len(languages)), np.float32)
            for i, g in enumerate(languages):
                keys, n = own[g]
                at = np.searchsorted(context, keys >> 8)
                total = np.bincount(at, weights=n, minlength=len(context))
                kinds = np.bincount(at, minlength=len(context))
                known = total > 0
                escape[known, i] = np.log2((total[known] + kinds[known]) / kinds[known])
                cost[:, i] = escape[where, i] + below[shorter, i]
                cost[np.searchsorted(gram, keys), i] = np.log2((total[at] + kinds[at]) / n)
            out.gram.append(gram)
            out.cost.append(cost)
            out.context.append(context)
            out.escape.append(escape)
            below = cost
        return out

    def bits(self, packed: np.ndarray) -> np.ndarray:
        """Code length of each byte (rows) in each language (columns)."""
        out = np.zeros((len(packed), len(self.languages)), np.float32)
        rest = np.arange(len(packed))
        for k in range(ORDER, -1, -1):
            g = packed[rest] & ((1 << 8 * (k + 1)) - 1)
            at = np.searchsorted(self.gram[k], g)
            at[at == len(self.gram[k])] = 0
            hit = self.gram[k][at] == g
            out[rest[hit]] += self.cost[k][at[hit]]
            rest, g = rest[~hit], g[~hit]
            if not len(rest):
                return out
            at = np.searchsorted(self.context[k], g >> 8)
            at[at == len(self.context[k])] = 0
            known = self.context[k][at] == g >> 8
            out[rest[known]] += self.escape[k][at[known]]
        out[rest] += 8.0
        return out


class Forest:
    """Trees of many languages, some in each part."""

    def __init__(self, parts: list[Trees]):
        self.parts = parts
        self.languages = [g for part in parts for g in part.languages]

    def bits(self, packed: np.ndarray) -> np.ndarray:
        return np.concatenate([part.bits(packed) for part in self.parts], axis=1)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", train_bytes: int = TRAIN_BYTES) -> Trees | Forest | None:
    """Context trees of the languages in ``docs``; None if there are none."""
    known = docs.where(F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    sizes = known.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("n")).groupBy("lang").agg(
        F.sum("n").alias("n")).collect()
    if not sizes:
        return None
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, train_bytes / r["n"])))])
    piece = max(1, min(PIECE, train_bytes // LEAST_PIECES))
    mask = (1 << 53) - 1
    drawn = F.filter(F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length("text") - 1) / piece)),
                     lambda i: F.xxhash64(F.col("h"), i).bitwiseAND(F.lit(mask)) / F.lit(float(mask + 1)) < share[F.col("lang")])
    rows = known.withColumn("numbers", drawn).where(F.size("numbers") > 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            out = []
            for t, g, h, numbers in zip(texts, *(batch.column(c).to_pylist() for c in ("lang", "h", "numbers")), strict=True):
                raw = bytes(ORDER) + t.encode("utf-8", "surrogatepass")
                out += [(g, h, i, raw[i * piece:(i + 1) * piece + ORDER]) for i in numbers]
            cols = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                             names=["lang", "h", "number", "piece"])

    sample = rows.mapInArrow(cut, "lang string, h long, number long, piece binary").dropDuplicates(["lang", "h", "number"]).select("lang", "piece")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                of, pieces = batch.column("lang").to_pylist(), batch.column("piece").to_pylist()
                for g in sorted(set(of)):
                    keys, n = np.unique(windows([b for b, x in zip(pieces, of, strict=True) if x == g])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(keys), pa.string()), pa.array(keys), pa.array(n)],
                                                     names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialise(counted)
    languages = sorted((r["lang"] for r in counted.select("lang").distinct().collect()), key=lambda s: s.encode())
    parts = []
    for i in range(0, len(languages), TOGETHER):
        own = languages[i:i + TOGETHER]
        found = counted.where(F.col("lang").isin(own)).toPandas()
        parts.append(Trees.learn(own, {g: (x["gram"].to_numpy(), x["n"].to_numpy()) for g, x in found.groupby("lang")}))
    return Forest(parts) if len(parts) > 1 else parts[0] if parts else None


def predict(docs: DataFrame, trees: Trees | Forest | None, text: str = "text") -> DataFrame:
    """All input columns but the text, with ``lang_pred`` and ``score``."""
    docs, back = shield(fresh(docs, "lang_pred", "score"), text)
    keep = [c for c in docs.columns if c != text]
    if trees is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")).withColumnsRenamed(back)
    model = docs.sparkSession.sparkContext.broadcast(trees)
    # Fewer characters a step when there are many languages: a step holds bytes times languages.
    step = max(50_000, 4_000_000 // len(trees.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch, texts in chunks(batches, text, step):
            packed, starts = grams(texts)
            sums = np.zeros((len(texts), len(m.languages)))
            for lo in range(0, len(packed), 2 * step):  # a text that is longer than a step
                bits = m.bits(packed[lo:lo + 2 * step])
                first = np.searchsorted(starts, lo, side="right") - 1
                own = np.maximum(starts[first:np.searchsorted(starts, lo + len(bits))] - lo, 0)
                sums[first:first + len(own)] += np.add.reduceat(bits, own, axis=0, dtype=np.float64)
            best = sums.argmin(axis=1)
            score = 1 / np.exp2(np.maximum(sums.min(axis=1)[:, None] - sums, -1000)).sum(axis=1)
            lettered = np.array([LETTER.search(t) is not None for t in texts])
            yield with_columns(batch, keep, lang_pred=pa.array([m.languages[b] if x else "und" for b, x in zip(best, lettered, strict=True)]),
                               score=pa.array(np.where(lettered, score, 0.0)))

    shape = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, shape).withColumnsRenamed(back)
