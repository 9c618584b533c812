"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model runs over characters, with ``ORDER`` - 1 characters of history: what marks broken text
(symbols glued to words, lists of fragments, shouting, random letters) shows there, and unlike words
no clean text has unseen ones. Trusted are the texts labelled good, and the model is
fitted to all of them, unless the caller asks for a sample (``trusted_texts``). N-gram counts of the trusted texts are summed over the cluster, and
every step of the model is a join of count tables that are sharded by n-gram: contexts bring the
discounted mass, shorter n-grams the lower-order probability.

Texts are scored by the same kind of join. The n-grams that make up at least one part in
``FREQUENT`` of the corpus, at most ``FREQUENT`` of them, go to the workers, which add up their share
of each text at once; so every other n-gram has a bounded share of the rows of the join, which takes
one row for each text and rare n-gram.

A text's mean code length per character is pulled towards its language's median as if it had
``SMOOTHING`` more characters, and compared with the language's cutoff: the ``quantile`` of the
trusted texts plus ``margin`` times its distance from the median. Medians and quantiles are those of
all trusted texts, fitted to or not. Languages with fewer than ``LEAST_TRUSTED`` trusted texts use the
quantiles of all languages together.

Edge cases: null and empty texts have no characters, the median's score, and are kept; null languages
are a language of their own; without trusted text nothing is rejected; labels that are null or
contradict each other for an id are left out; rows that repeat are scored alike; an empty table gives
an empty table; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minpair.llm.texts import agreed_labels, chunks, fresh, place, shield, with_columns, without
from minpair.session import materialise

ORDER = 3
BITS = 21  # of a code point
FREQUENT = 200_000
#: Characters that are counted or scored at once.
STEP = 500_000
#: A sample, where one is asked for, has about so many texts at least of every language that has them.
LANGUAGE_TEXTS = 2_000
#: Words of 64 bits of the filter that tells texts that can't be trusted without a shuffle.
FILTER_WORDS = 2 ** 18
SMOOTHING = 50.0
LEAST_TRUSTED = 30
ADDED = ("n_chars_scored", "bits_per_char", "perplexity", "cutoff", "kept")


def char_grams(text: str) -> np.ndarray:
    """For each character, it and the ``ORDER - 1`` before it (0 before the start) as one integer."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = code.copy()
    for k in range(1, ORDER):
        out[k:] |= code[:-k] << (BITS * k)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches, "text", STEP):
        trusted = np.array(batch.column("trusted").to_pylist(), bool)
        for flag in (True, False):
            own = [char_grams(t) for t, y in zip(texts, trusted, strict=True) if y == flag and t]
            if own:
                keys, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(n * flag)], names=["gram", "n", "c"])


def counts(docs: DataFrame, text: str, trusted: Column) -> DataFrame:
    """``(gram, n, c)``: occurrences of every n-gram in all texts and in the trusted ones."""
    rows = docs.select(F.col(text).alias("text"), F.coalesce(trusted, F.lit(False)).alias("trusted"))
    return materialise(rows.mapInArrow(_counted, "gram long, n long, c long").groupBy("gram").agg(
        F.sum("n").alias("n"), F.sum("c").alias("c")))


def _discounts(table: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney from the counts of counts; where the small counts
    are missing, as in tiny tables, a half, one and one and a half."""
    found = {r["c"]: r["n"] for r in table.where("c between 1 and 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n = [found.get(k, 0) for k in range(1, 5)]
    if not n[0] or not n[1]:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else k + 1 for k in range(3)]
    return [min(max(d, 0.0), k + 1.0) for k, d in enumerate(raw)]


def _tables(grams: DataFrame) -> list[tuple[DataFrame, DataFrame, list[float]]]:
    """For each order from 1: n-grams with their count (continuations below the highest order) and
    their contexts with the total and the interpolation weight."""
    table, out = grams.where("c > 0").select("gram", "c"), []
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            table = table.select(F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("gram")).groupBy("gram").agg(
                F.count("*").alias("c"))
        table = materialise(table)
        d = _discounts(table)
        kinds = [F.sum(F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])).alias("mass")]
        context = table.groupBy(F.shiftright("gram", BITS).alias("context")).agg(F.sum("c").alias("total"), *kinds)
        out.append((table, materialise(context.withColumn("weight", F.col("mass") / F.col("total")).drop("mass")), d))
    return out[::-1]


def probabilities(grams: DataFrame) -> DataFrame:
    """``(gram, n, bits)``: code length of the last character of every n-gram of the corpus, seen in
    trusted text or not."""
    levels = _tables(grams)
    kinds = levels[0][0].count()
    uniform = 1.0 / (kinds + 1)
    lower: DataFrame | None = None
    for order, (table, context, d) in enumerate(levels, 1):
        # All n-grams of this order that the corpus has: suffixes of the full ones.
        wanted = grams.select(F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("gram")).distinct()
        rows = wanted.join(table, "gram", "left").withColumn("context", F.shiftright("gram", BITS)).join(context, "context", "left")
        if lower is None:
            rows = rows.withColumn("below", F.lit(uniform))
        else:
            rows = rows.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))).join(
                lower.select(F.col("gram").alias("short"), F.col("p").alias("below")), "short")
        own = F.when(F.col("c") == 1, F.col("c") - d[0]).when(F.col("c") == 2, F.col("c") - d[1]).otherwise(F.col("c") - d[2])
        p = F.coalesce(own / F.col("total"), F.lit(0.0)) + F.coalesce(F.col("weight"), F.lit(1.0)) * F.col("below")
        lower = rows.select("gram", p.alias("p"))
    return materialise(grams.select("gram", "n").join(lower, "gram").select("gram", "n", (-F.log2("p")).alias("bits")))


def code_lengths(docs: DataFrame, model: DataFrame, text: str) -> DataFrame:
    """All columns but the text, with ``n_chars_scored`` and ``bits``, the text's code length."""
    keep = [c for c in docs.columns if c != text]
    total = model.agg(F.sum("n").alias("n")).first()["n"] or 0
    often = model.where(F.col("n") >= max(1.0, total / FREQUENT)).select("gram", "bits").toPandas().sort_values("gram")
    shared = docs.sparkSession.sparkContext.broadcast((often["gram"].to_numpy(np.int64), often["bits"].to_numpy(float)))
    rare_type = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, bits = shared.value
        for batch, texts in chunks(batches, text, STEP):
            lengths = [len(t) for t in texts]
            packed = np.concatenate([char_grams(t) for t in texts]) if texts else np.empty(0, np.int64)
            at = np.searchsorted(gram, packed)
            at[at == len(gram)] = 0
            hit = gram[at] == packed if len(gram) else np.zeros(len(packed), bool)
            cost = np.where(hit, bits[at], 0.0) if len(gram) else np.zeros(len(packed))
            sums = np.cumsum(np.append(0.0, cost))
            edge = np.cumsum([0, *lengths])
            missed = np.nonzero(~hit)[0]
            cut = np.searchsorted(missed, edge)
            own = [np.unique(packed[missed[a:b]], return_counts=True) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            found = pa.StructArray.from_arrays([pa.array(np.concatenate([x[k] for x in own]), t) for k, t in enumerate((pa.int64(), pa.int32()))],
                                               fields=list(rare_type.value_type))
            rare = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x[0]) for x in own)]), pa.int32()), found)
            yield with_columns(batch, keep, n_chars_scored=pa.array(lengths, pa.int64()),
                               often_bits=pa.array(sums[edge[1:]] - sums[edge[:-1]]), rare=rare.cast(rare_type))

    shape = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_chars_scored", T.LongType()), T.StructField("often_bits", T.DoubleType()),
                          T.StructField("rare", T.ArrayType(T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.IntegerType())])))])
    # Written once, so that the row numbers of both uses agree.
    rows = materialise(docs.mapInArrow(run, shape)).withColumn("_row", F.monotonically_increasing_id())
    each = rows.select("_row", F.explode("rare").alias("r")).select("_row", "r.gram", F.col("r.n").alias("k"))
    rare_bits = each.join(model.select("gram", "bits"), "gram").groupBy("_row").agg(F.sum(F.col("k") * F.col("bits")).alias("rare_bits"))
    return rows.join(rare_bits, "_row", "left").withColumn(
        "bits", F.col("often_bits") + F.coalesce("rare_bits", F.lit(0.0))).drop("_row", "rare", "often_bits", "rare_bits")


def trusted(docs: DataFrame, labels: DataFrame, doc_id: str, lang: str, label: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(_id)`` of all texts labelled good, and of those to fit to: all, or with ``most`` about so many, and
    about ``LANGUAGE_TEXTS`` of every language that has so many. Only ids and languages are joined."""
    ids = agreed_labels(labels, doc_id, label).where("_y = 1").select("_id")
    each = materialise(docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang")).distinct().join(ids.hint("merge"), "_id"))
    good = materialise(each.select("_id").distinct())
    if most is None:
        return good, good
    sizes = each.groupBy("_lang").agg(F.count("*").alias("_n"))
    total = each.count()
    share = F.greatest(F.lit(most / max(1, total)), F.lit(float(LANGUAGE_TEXTS)) / F.col("_n"))
    drawn = each.join(sizes.select(F.col("_lang").alias("_l"), share.alias("_share")), F.col("_lang").eqNullSafe(F.col("_l"))).where(place() < F.col("_share"))
    return good, materialise(drawn.select("_id").distinct())


def marked(docs: DataFrame, ids: DataFrame, doc_id: str) -> DataFrame:
    """``docs`` with ``_trusted``: whether the id is among ``ids``. The ids grow with the input, so they are joined
    by shuffle; a broadcast filter of ``FILTER_WORDS`` words, which every hash of an id has a bit in, spares
    that to nearly all texts that are not among them."""
    def spot(key: str) -> tuple[Column, Column]:
        h = F.xxhash64(key)
        return F.shiftright(h, 6).bitwiseAND(F.lit(FILTER_WORDS - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))

    word, bit = spot("_id")
    bits = ids.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    word, bit = spot(doc_id)
    near = docs.join(F.broadcast(bits), word == F.col("_word"), "left")
    near = near.withColumn("_near", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")
    known = ids.select(F.col("_id").alias("_good"), F.lit(True).alias("_trusted"))
    exact = near.where("_near").join(known.hint("merge"), F.col(doc_id) == F.col("_good"), "left").drop("_good", "_near")
    return near.where(~F.col("_near")).drop("_near").withColumn("_trusted", F.lit(False)).unionByName(
        exact.withColumn("_trusted", F.coalesce("_trusted", F.lit(False))))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          label: str = "quality", quantile: float = 0.99, margin: float = 1.0, trusted_texts: int | None = None) -> DataFrame:
    """All input columns but the text, with ``n_chars_scored``, ``bits_per_char`` (pulled towards the
    median), ``perplexity`` (the text's own, per character; null without characters), the language's
    ``cutoff`` for ``bits_per_char``, and ``kept``."""
    docs, back = shield(fresh(docs, *ADDED), doc_id, text, lang)
    good, fitted = trusted(docs, labels, doc_id, lang, label, trusted_texts)
    grams = counts(marked(docs.select(doc_id, text), fitted, doc_id), text, F.col("_trusted"))
    scored = materialise(code_lengths(docs, probabilities(grams), text))
    raw = F.col("bits") / F.col("n_chars_scored")
    # Scored rows have no text, so the shuffle of this join is small.
    known = materialise(scored.where("n_chars_scored > 0").select(
        F.col(doc_id).alias("_known"), F.col(lang).alias("_lang"), raw.alias("raw"), "bits", F.col("n_chars_scored").alias("n")).join(
        good.hint("merge"), F.col("_known") == F.col("_id"), "left_semi").drop("_known"))
    middle = F.percentile_approx("raw", 0.5, 10_000).alias("mid")
    own = known.groupBy("_lang").agg(middle, F.count("*").alias("trusted"))
    overall = known.agg(middle).first()["mid"]
    if overall is None:
        return scored.select(*[c for c in docs.columns if c != text], "n_chars_scored", F.lit(None).cast("double").alias("bits_per_char"),
                             F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("cutoff"), F.lit(True).alias("kept")).withColumnsRenamed(back)

    def pulled(bits: Column, n: Column, mid: Column) -> Column:
        return (bits + F.lit(SMOOTHING) * mid) / (n + F.lit(SMOOTHING))

    top = F.percentile_approx("x", quantile, 10_000)
    tops = known.join(own.select(F.col("_lang").alias("_l"), "mid"), F.col("_lang").eqNullSafe(F.col("_l"))).withColumn(
        "x", pulled(F.col("bits"), F.col("n"), F.col("mid"))).groupBy("_lang").agg(top.alias("top"))
    overall_top = known.withColumn("x", pulled(F.col("bits"), F.col("n"), F.lit(overall))).agg(top.alias("t")).first()["t"]
    enough = F.col("trusted") >= LEAST_TRUSTED
    lines = materialise(own.join(tops.withColumnRenamed("_lang", "_l"), F.col("_lang").eqNullSafe(F.col("_l"))).where(enough).select(
        "_lang", "mid", "top"))
    rows = scored.join(lines, F.col(lang).eqNullSafe(F.col("_lang")), "left")
    mid, top_ = F.coalesce("mid", F.lit(overall)), F.coalesce("top", F.lit(overall_top))
    rows = rows.withColumn("bits_per_char", pulled(F.col("bits"), F.col("n_chars_scored"), mid)).withColumn(
        "cutoff", top_ + margin * (top_ - mid))
    return rows.select(*[c for c in docs.columns if c != text], "n_chars_scored", "bits_per_char",
                       F.when(F.col("n_chars_scored") > 0, F.pow(F.lit(2.0), raw)).alias("perplexity"), "cutoff",
                       (F.col("bits_per_char") <= F.col("cutoff")).alias("kept")).withColumnsRenamed(back)


def reject(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
           label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged."""
    verdicts = score(docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lg"), F.xxhash64(text).alias("_t"), F.col(text).alias("_x")),
                     labels.withColumnRenamed(doc_id, "_id"), "_id", "_x", "_lg", label)
    return without(docs, verdicts.where(~F.col("kept")), doc_id, text)
