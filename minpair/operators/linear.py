"""Linear text classifier trained by joins, and its scorers.

A one-vs-rest hinge loss with an L2 term is minimised by a fixed number of full-batch subgradient rounds
(step ``1 / (reg * round)``, zero start, no draw of rows). The coefficients of the ``MOST_COMMON`` terms that
most documents have are an array that every task gets; a document is one row with its common terms'
numbers, so a round is one pass over the documents that adds their scores and the gradient up. All other
terms, a small share of the occurrences, stay in tables: a round joins them to their coefficients, adds
the products up by document, and joins the documents inside the margin back to them. The driver holds the
common terms and the intercepts.

Features and coefficients are whole numbers (``FEATURE`` and ``UNIT`` to one), so every sum is exact and
a model does not depend on partitions or on the engine.

Features are counts of words, or of characters (for languages without blanks), divided by the length
of the document's vector; with ``use_idf`` they are weighted by ``ln((1 + N) / (1 + df)) + 1`` first, and terms
that no training document has are left out.

NULL texts have no features and are scored by the intercepts; rows with a NULL label do not train; ids
must be unique; equal scores give the first class; a table without labels can't train (``ValueError``).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minpair.functions.labels import argmax
from minpair.functions.ranking import least_common
from minpair.functions.text import char_tokens, word_tokens
from minpair.operators.ml import term_counts
from minpair.session import dealt_by, materialise, parts_of, stored

FEATURE, UNIT, IDF_UNIT = 2 ** 10, 2 ** 30, 64
#: Terms of most documents whose coefficients every task gets, and the bits of a feature (``FEATURE`` at most).
MOST_COMMON, X_BITS = 200_000, 11
#: Terms up to which a model is sent to Python workers as a whole; larger ones are joined.
MOST_SENT_TERMS = 1_000_000


@dataclass
class LinearModel:
    """``coefficients``: ``term, w0, w1, ...`` (longs, ``UNIT`` to one), one column for each of ``classes``;
    ``idf``: ``term, idf`` (``IDF_UNIT`` to one) or None for plain counts."""

    classes: list
    coefficients: DataFrame
    intercepts: list[int]
    idf: DataFrame | None = None
    chars: bool = False

    def table(self) -> DataFrame:
        """Coefficients in long form: ``class_id, term, weight``; the intercept's term is empty."""
        spark = self.coefficients.sparkSession
        rows = self.coefficients.select("term", F.posexplode(F.array(*self.columns())).alias("class_id", "weight"))
        own = spark.createDataFrame([(c, "", w) for c, w in enumerate(self.intercepts)], "class_id int, term string, weight long")
        return rows.select("class_id", "term", "weight").unionByName(own)

    def columns(self) -> list[str]:
        return [f"w{c}" for c in range(len(self.classes))]


def idf_table(counts: DataFrame, n_docs: int) -> DataFrame:
    """``term, idf`` in whole ``IDF_UNIT``-ths."""
    value = F.log((1.0 + F.lit(n_docs)) / (1.0 + F.count(F.lit(1)))) + 1.0
    return counts.groupBy("term").agg(F.floor(value * IDF_UNIT + 0.5).alias("idf"))


def features(counts: DataFrame, id_col: str, idf: DataFrame | None = None, parts: int = 1) -> DataFrame:
    """M03 / M04 as whole numbers: ``id, term, x`` from ``id, term, n``; values that round down to 0 are
    left out. The vector's length is summed on the documents' partitioning; with ``idf`` the rows are dealt
    anew, to ``parts`` tasks."""
    w = F.col("n").cast("double")
    if idf is not None:
        counts = dealt_by(counts.join(idf, "term"), parts, id_col)
        w = w * F.col("idf")
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    x = counts.withColumn("w", w).withColumn("x", F.floor(F.lit(float(FEATURE)) * F.col("w") / length))
    return x.where("x > 0").select(id_col, "term", "x")


def margins(docs: DataFrame, x: DataFrame, id_col: str, coefficients: DataFrame, intercepts: list[int]) -> DataFrame:
    """``docs`` with ``s0, s1, ...``, the score of every class in ``FEATURE * UNIT``-ths."""
    k = range(len(intercepts))
    sums = x.join(coefficients, "term").groupBy(id_col).agg(*[F.sum(F.col("x") * F.col(f"w{c}")).alias(f"s{c}") for c in k])
    full = docs.join(sums, id_col, "left")
    return full.withColumns({f"s{c}": F.coalesce(f"s{c}", F.lit(0)) + F.lit(FEATURE * intercepts[c]) for c in k})


def numbered(x: DataFrame, id_col: str) -> tuple[list[str], DataFrame]:
    """The ``MOST_COMMON`` terms at most that most documents have, and a row for each document: ``packed``, its
    common terms' numbers with ``x`` in the last ``X_BITS`` bits, and ``rare``, the other terms with ``x``."""
    rows = stored(x.groupBy(id_col).agg(F.collect_list(F.struct("term", F.col("x").cast("int").alias("x"))).alias("f")))
    often = stored(rows.select(F.explode("f.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    least = least_common(often, "df", MOST_COMMON)
    names = sorted(r[0] for r in often.where(F.col("df") >= max(2, least)).select("term").collect())  # bounded
    sent = x.sparkSession.sparkContext.broadcast(names)
    kind = pa.list_(pa.struct([("term", pa.string()), ("x", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            f = batch.column("f").cast(kind)
            flat, ends = f.flatten(), np.cumsum(np.append(0, f.value_lengths().to_numpy()))
            at = pc.index_in(flat.field("term"), value_set=known)
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            value = flat.field("x").to_numpy()
            before = np.cumsum(np.append(0, hit))
            packed = (at.drop_null().to_numpy().astype(np.int32) << X_BITS) | value[hit]
            other = flat.filter(pa.array(~hit))
            yield pa.RecordBatch.from_arrays([
                batch.column(id_col), pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), pa.array(packed, pa.int32())),
                pa.ListArray.from_arrays(pa.array(ends - before[ends], pa.int32()), other)], names=[id_col, "packed", "rare"])

    shape = T.StructType([rows.schema[id_col], T.StructField("packed", T.ArrayType(T.IntegerType())), T.StructField(
        "rare", T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("x", T.IntegerType())])))])
    return names, stored(rows.mapInArrow(run, shape))


def _round(rows: DataFrame, id_col: str, common: np.ndarray, intercepts: list[int], first: bool) -> DataFrame:
    """One pass over the documents, ``id, y0, ..., packed, r0, ...`` (what the rare terms add to the scores):
    a row ``id, g0, ...`` with ``y`` of the classes whose margin the document is inside, else 0, and rows
    ``t, g0, ...`` with a task's gradient by common term, the intercepts' as the last."""
    classes, many = common.shape
    sent = rows.sparkSession.sparkContext.broadcast(common)
    kind = rows.schema[id_col]
    grads = [f"g{c}" for c in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = sent.value, np.zeros((classes, many + 1), np.int64)
        id_type = None
        for batch in batches:
            lists, id_type = batch.column("packed"), batch.column(id_col).type
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            ends = np.cumsum(np.append(0, sizes))
            t, x = flat >> X_BITS, (flat & ((1 << X_BITS) - 1)).astype(np.int64)
            inside = []
            for c in range(classes):
                y = batch.column(f"y{c}").to_numpy()
                if not first:
                    sums = np.cumsum(np.append(0, x * w[c][t]))
                    score = sums[ends[1:]] - sums[ends[:-1]] + batch.column(f"r{c}").to_numpy() + FEATURE * intercepts[c]
                    y = np.where(y * score < FEATURE * UNIT, y, 0)
                # Sums of one batch are far below 2 ** 53, so doubles hold them exactly.
                total[c, :many] += np.bincount(t, x * np.repeat(y, sizes), many).astype(np.int64)
                total[c, many] += y.sum()
                inside.append(pa.array(y, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.nulls(len(batch), pa.int32()), *inside], names=[id_col, "t", *grads])
        if id_type is not None:
            at = np.flatnonzero(total.any(axis=0)).astype(np.int32)
            for part in np.array_split(at, max(1, len(at) // 10_000)):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), id_type), pa.array(part), *[pa.array(total[c, part]) for c in range(classes)]],
                                                 names=[id_col, "t", *grads])

    shape = T.StructType([T.StructField(id_col, kind.dataType), T.StructField("t", T.IntegerType()), *[T.StructField(g, T.LongType()) for g in grads]])
    return rows.mapInArrow(run, shape)


def step(reg: float, at: int) -> float:
    """What a round's gradient sum is divided by, for one document."""
    return FEATURE * reg * at


def train(df: DataFrame, id_col: str, text_col: str, label_col: str, rounds: int = 8, reg: float = 0.01,
          chars: bool = False, use_idf: bool = False) -> LinearModel:
    """M05 on all labelled rows of ``df``."""
    df = df.where(F.col(label_col).isNotNull())
    labels = df.groupBy(label_col).count().collect()  # one row a class
    if not labels:
        raise ValueError("no labelled rows to train on")
    classes, n_docs = sorted(r[0] for r in labels), sum(r["count"] for r in labels)
    k = range(len(classes))
    parts = parts_of(df, text_col)
    counts = term_counts(df, id_col, text_col, chars=chars, parts=parts)
    idf = None
    if use_idf:
        counts = stored(counts)
        idf = materialise(idf_table(counts, n_docs))
    names, vectors = numbered(features(counts, id_col, idf, parts).where(F.col(id_col).isNotNull()), id_col)
    signs = [F.when(F.col(label_col) == c, 1).otherwise(-1).cast("long").alias(f"y{i}") for i, c in enumerate(classes)]
    docs = dealt_by(df.select(id_col, *signs), parts // 4, id_col).join(vectors.drop("rare"), id_col, "left")
    docs = materialise(docs.withColumn("packed", F.coalesce("packed", F.array().cast("array<int>"))))
    rare = stored(vectors.select(id_col, F.explode("rare").alias("r")).select(id_col, "r.term", "r.x"))
    if rare.isEmpty():
        rare = None
    common, rarer, intercepts = np.zeros((len(classes), len(names)), np.int64), None, [0] * len(classes)
    for at in range(1, rounds + 1):
        rows = docs
        if rarer is not None:
            sums = rare.join(rarer, "term").groupBy(id_col).agg(*[F.sum(F.col("x") * F.col(f"w{c}")).alias(f"r{c}") for c in k])
            rows = dealt_by(docs, parts // 4, id_col).join(sums, id_col, "left")
        rows = rows.withColumns({f"r{c}": F.coalesce(f"r{c}", F.lit(0)).cast("long") if rarer is not None else F.lit(0).cast("long") for c in k})
        out = materialise(_round(rows, id_col, common, intercepts, first=at == 1))
        keep, rate = (at - 1) / at, UNIT / (step(reg, at) * n_docs)
        # A row for each common term, and one of the intercepts' sums.
        found = out.where("t is not null").groupBy("t").agg(*[F.sum(f"g{c}").alias(f"g{c}") for c in k]).toArrow()
        gradient = np.zeros((len(classes), len(names) + 1), np.int64)
        for c in k:
            gradient[c, found.column("t").to_numpy()] = found.column(f"g{c}").to_numpy()
        common = np.floor(common * keep + gradient[:, :-1] * rate + 0.5).astype(np.int64)
        intercepts = [math.floor(intercepts[c] * keep + float(FEATURE * int(gradient[c, -1])) * rate + 0.5) for c in k]
        if rare is not None:
            inside = out.where("t is null").select(id_col, *[f"g{c}" for c in k])
            own = rare.join(inside, id_col).groupBy("term").agg(*[F.sum(F.col("x") * F.col(f"g{c}")).alias(f"g{c}") for c in k])
            old = own.withColumns({f"w{c}": F.lit(0) for c in k}) if rarer is None else rarer.join(own, "term")
            rarer = materialise(old.select("term", *[
                F.floor(F.col(f"w{c}") * F.lit(keep) + F.col(f"g{c}") * F.lit(rate) + 0.5).alias(f"w{c}") for c in k]))
    rows = pa.table({"term": pa.array(names, pa.string())} | {f"w{c}": pa.array(common[c]) for c in k})
    shape = T.StructType([T.StructField("term", T.StringType()), *[T.StructField(f"w{c}", T.LongType()) for c in k]])
    coefficients = df.sparkSession.createDataFrame(rows, shape)
    if rarer is not None:
        coefficients = coefficients.unionByName(rarer)
    return LinearModel(classes, materialise(coefficients), intercepts, idf, chars)


def predict(df: DataFrame, id_col: str, text_col: str, model: LinearModel, out: str = "prediction") -> DataFrame:
    """M08 by joins, at any size of the model: ``df`` with ``out`` (a class) and ``out_scores`` (all scores)."""
    x = features(term_counts(df, id_col, text_col, chars=model.chars), id_col, model.idf)
    k = range(len(model.classes))
    scored = margins(df, x, id_col, model.coefficients, model.intercepts)
    scored = scored.withColumn(f"{out}_scores", F.array(*[F.col(f"s{c}") for c in k]))
    return scored.withColumn(out, F.element_at(F.array(*[F.lit(c) for c in model.classes]), argmax(F.col(f"{out}_scores")) + 1)).drop(
        *[f"s{c}" for c in k])


class SentModel:
    """A model as Python workers hold it, made once for each of them from the broadcast rows."""

    _made: tuple[list, dict] | None = None

    @classmethod
    def of(cls, broadcast, loads) -> dict:
        """The terms of a broadcast; a worker makes them at first use and counts that in ``loads``."""
        rows = broadcast.value  # a worker keeps it from task to task
        if cls._made is None or cls._made[0] is not rows:
            cls._made = (rows, {r[0]: r[1:] for r in rows})
            if loads is not None:
                loads.add(1)
        return cls._made[1]


def scorer(model: LinearModel, loads=None):
    """M08 as an iterator pandas UDF over arrays of tokens that gives the class. The model must have at most
    ``MOST_SENT_TERMS`` terms. ``loads``: an accumulator that counts how often a worker took the model in."""
    spark = model.coefficients.sparkSession
    rows = model.coefficients
    if model.idf is not None:
        rows = rows.join(model.idf, "term", "right")
        rows = rows.na.fill(0, model.columns())
    else:
        rows = rows.withColumn("idf", F.lit(1))
    rows = rows.select("term", "idf", *model.columns())
    if rows.count() > MOST_SENT_TERMS:
        raise ValueError(f"over {MOST_SENT_TERMS} terms: score by `predict`")
    sent = spark.sparkContext.broadcast([tuple(r) for r in rows.collect()])
    classes, intercepts, weighted = model.classes, model.intercepts, model.idf is not None
    kind = {int: "long", float: "double", str: "string"}[type(classes[0])]

    def one(tokens, terms: dict):
        counts = Counter(tokens if tokens is not None else ())
        w = {t: n * terms[t][0] if weighted else n for t, n in counts.items() if not weighted or t in terms}
        length = math.sqrt(sum(float(v) * v for v in w.values()))
        scores = [FEATURE * b for b in intercepts]
        for t, v in w.items():
            held = terms.get(t)
            if held is not None:
                x = math.floor(float(FEATURE) * v / length)
                scores = [s + x * c for s, c in zip(scores, held[1:], strict=True)]
        return classes[max(range(len(scores)), key=lambda c: (scores[c], -c))]

    @F.pandas_udf(kind)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = SentModel.of(sent, loads)
        for batch in batches:
            yield batch.map(lambda tokens: one(tokens, terms)) if len(batch) else pd.Series([], dtype=object)

    return label


def tokens_of(text: Column, model: LinearModel) -> Column:
    """Tokens as the model counts them."""
    return char_tokens(text) if model.chars else word_tokens(text)


def score_corpus(df: DataFrame, text_col: str, model: LinearModel, out: str = "label", loads=None) -> DataFrame:
    """M08 for a corpus: every row labelled by the model in Python workers, which get the terms that the
    corpus has; if these are too many as well, by joins on a number of the row."""
    if model.coefficients.count() > MOST_SENT_TERMS:
        used = materialise(df.select(F.explode(tokens_of(F.col(text_col), model)).alias("term")).distinct())
        own = materialise(model.coefficients.join(used, "term", "left_semi"))
        idf = None if model.idf is None else materialise(model.idf.join(used, "term", "left_semi"))
        model = replace(model, coefficients=own, idf=idf)
    if max(model.coefficients.count(), 0 if model.idf is None else model.idf.count()) > MOST_SENT_TERMS:
        row, text = "__row", "__text"
        rows = materialise(df.withColumn(row, F.monotonically_increasing_id()))
        labels = predict(rows.select(row, F.col(text_col).alias(text)), row, text, model, "__p").select(row, F.col("__p").cast("int").alias(out))
        return rows.drop(out).join(labels, row).select(*[c for c in df.columns if c != out], out)
    return df.withColumn(out, scorer(model, loads)(tokens_of(F.col(text_col), model)).cast("int"))
