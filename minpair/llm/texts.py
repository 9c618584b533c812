"""Small text helpers shared by the operators: words, chunks of rows, Arrow plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minpair.session import materialise

#: White space that separates words: space and U+0009..U+000D, the same set as ``bytes.split()``.
SPACE_CLASS = r"[\x09-\x0D ]"
CHUNK_CHARS = 4_000_000


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased; null gives none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_count(text: Column) -> Column:
    """Number of words as a native expression; null counts 0."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"),
                           lambda w: w != "")).cast("long")


def hash_words(ws: list[bytes]) -> np.ndarray:
    """64-bit hash of each word, equal on every machine."""
    import pandas as pd  # here, as only few workers need it and it takes 25 MB in each

    if not ws:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(ws, dtype=object), categorize=False)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_CHARS
           ) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts hold about ``limit`` characters, so that memory stays
    bounded however many rows a batch has, and only a slice's texts are Python strings; a longer text is
    a slice of its own. Null texts come as empty. After the last batch Arrow's unused memory goes back to the system, as the worker lives on."""
    def part(batch: pa.RecordBatch, start: int, end: int) -> tuple[pa.RecordBatch, list[str]]:
        own = batch.slice(start, end - start)
        return own, [t or "" for t in own.column(text).to_pylist()]

    for batch in batches:
        start = size = 0
        for i, n in enumerate(pc.utf8_length(batch.column(text)).to_pylist()):
            n = n or 0
            if i > start and size + n > limit:
                yield part(batch, start, i)
                start, size = i, 0
            size += n
        if start < len(batch):
            yield part(batch, start, len(batch))
    batch = None
    pa.default_memory_pool().release_unused()


def with_columns(batch: pa.RecordBatch, keep: list[str], **new: pa.Array) -> pa.RecordBatch:
    """``keep`` columns of the batch followed by new ones."""
    return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + list(new.values()),
                                      names=[*keep, *new])


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that an operator is about to add under the same names."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def private(*names: str) -> list[str]:
    """Column names that no input has."""
    mark = uuid.uuid4().hex
    return [f"{name}_{mark}" for name in names]


def shield(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with every column but the used ones under a name that no operator uses within, and
    the names to go back to with ``withColumnsRenamed``."""
    hidden = dict(zip(private(*(f"c{i}" for i in range(len(docs.columns)))), docs.columns, strict=True))
    back = {h: c for h, c in hidden.items() if c not in used}
    return docs.withColumnsRenamed({c: h for h, c in back.items()}), back


def without(docs: DataFrame, rejected: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of ``docs`` that are not among the rejected ``(_id, _t)``, id and hash of the text. Rows
    alike in both have the same verdict, so the columns name rows well enough; null ids count as
    equal."""
    gone = rejected.select(F.col("_id").alias("_gone"), F.col("_t").alias("_gone_t")).distinct()
    docs, back = shield(docs, doc_id, text)
    rows = docs.withColumn("_h", F.xxhash64(text))
    # A shuffle join at every size, as the rejected rows grow with the input.
    return rows.join(gone.hint("merge"), F.col(doc_id).eqNullSafe(F.col("_gone")) & (F.col("_h") == F.col("_gone_t")), "left_anti").drop("_h").withColumnsRenamed(back)


def place() -> Column:
    """Place of the id ``_id`` in a random order, from 0 to 1."""
    return F.xxhash64("_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def agreed_labels(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """``(_id, _y)``, without null labels and ids with contradicting labels."""
    return labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.min(label).cast("int").alias("_y"), F.max(label).cast("int").alias("_hi")).where("_y = _hi").select("_id", "_y")


def sampled_labels(docs: DataFrame, labels: DataFrame, doc_id: str, label: str, most: dict[int, int]
                   ) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
    """A bounded sample of labelled ids: about ``most[y]`` ids with label y that ``docs`` has, selected
    by a hash of the id. Null labels and ids with contradicting labels are left out. Returns
    ``(_id, _y)``, how many ids each label has, and the share of them that was taken. Only ids are
    joined here, so the texts of the sample can be had by a broadcast of it."""
    known = agreed_labels(labels, doc_id, label).where(F.col("_y").isin(*most)).join(
        docs.select(F.col(doc_id).alias("_id")).distinct().hint("merge"), "_id")
    known = materialise(known)
    total = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, most[y] / n) for y, n in total.items()}
    kept = F.lit(False)
    for y, part in share.items():
        kept = kept | ((F.col("_y") == y) & (place() < part))
    return materialise(known.where(kept)), total, share
