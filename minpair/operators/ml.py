"""Features, models and scoring, re-aimed as Spark jobs.

Bag-of-words and tf-idf are built in long form ``(doc, term, value)`` with ``groupBy`` (checkable
against SQL and sparse by construction); the linear classifier is a Spark ML pipeline; scoring a
corpus is ``PipelineModel.transform`` or a user pandas UDF applied by ``mapInPandas``-style batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minpair.functions.labels import gold_from_emotion, polarity
from minpair.functions.ranking import hash_key, least_common, positions
from minpair.functions.text import char_tokens, word_tokens
from minpair.session import dealt_by, materialise, parts_of, stored


def term_counts(df: DataFrame, id_col: str, text_col: str, chars: bool = False, parts: int | None = None) -> DataFrame:
    """M03 (long form): ``(id, term, n)`` from T10 word tokens (``chars``: characters) over the whole text.

    Documents are hash-partitioned by id *before* tokenising: the shuffle moves each text once
    (cheaper than moving its per-term rows), spreads the regex work over all tasks, and the per-
    document aggregation then needs no exchange. There are as many parts as the texts fill (``parts``, if
    it is known), so the pairs that a task holds are bounded.
    """
    docs = dealt_by(df.select(id_col, text_col), parts or parts_of(df, text_col), id_col)
    t = docs.select(id_col, F.explode((char_tokens if chars else word_tokens)(F.col(text_col))).alias("term"))
    return t.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"))


#: Terms of an idf table or a vocabulary that are sent to all tasks: all, or those of most rows.
MOST_SENT_IDF = 500_000
MOST_SENT_WORDS = 200_000


def tfidf(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """M04 (long form): ``tf * (ln((1 + N) / (1 + df)) + 1)``, L2-normalised per document.

    ``N`` is the number of rows of ``df``. The term counts are written once and read for the document
    frequencies and for the weights, so texts are tokenised once. An idf table of at most ``MOST_SENT_IDF``
    terms is sent to all tasks; of a larger one the terms of most documents are, and only the rows of the
    others are joined by term. The norm is a window over a document's terms, dealt by document to as many
    tasks as the texts fill.
    """
    parts = parts_of(df, text_col)
    tc = stored(term_counts(df, id_col, text_col, parts=parts))
    n_docs = df.count()  # one scalar
    dfreq = tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = materialise(dfreq.select("term", "df", (F.log((1.0 + F.lit(n_docs)) / (1.0 + F.col("df"))) + 1.0).alias("idf")))
    w = _by_common_terms(tc, idf, "df", MOST_SENT_IDF).select(id_col, "term", "n", (F.col("n") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return dealt_by(w, parts, id_col).select(id_col, "term", "n", (F.col("w") / norm).alias("tfidf"))


def _by_common_terms(rows: DataFrame, table: DataFrame, count: str, most: int) -> DataFrame:
    """``rows`` joined to ``table``, one row a term: it is sent as a whole if it has at most ``most`` terms, else
    the terms of the largest ``count``, and the rows of the others are joined by shuffle."""
    if table.count() <= most:
        return rows.join(F.broadcast(table), "term")
    least = least_common(table, count, most)
    common, rest = table.where(F.col(count) >= least), table.where(F.col(count) < least)
    others = rows.join(F.broadcast(common.select("term")), "term", "left_anti")
    return rows.join(F.broadcast(common), "term").unionByName(others.join(rest.hint("merge"), "term"))


#: Terms up to which a vector model is fitted: Spark ML keeps the vocabulary and one coefficient a
#: term and class on the driver. More terms raise; none is dropped.
MOST_TERMS = 20_000_000


def count_vectorizer(df: DataFrame, tokens_col: str, out: str, min_df: float = 1.0, max_terms: int = MOST_TERMS) -> CountVectorizer:
    """A ``CountVectorizer`` wide enough for every term of ``df``."""
    n = df.select(F.explode(tokens_col).alias("t")).distinct().count()
    if n > max_terms:
        raise ValueError(f"{n} terms; a vector model takes {max_terms} at most, use the long form")
    return CountVectorizer(inputCol=tokens_col, outputCol=out, minDF=min_df, vocabSize=max(1, n))


def vectorise(df: DataFrame, tokens_col: str, out: str = "features", min_df: float = 1.0,
              use_idf: bool = False) -> tuple[DataFrame, PipelineModel]:
    """M03 / M04 vector form with Spark ML: counts, or ``tf * (ln((1 + N) / (1 + df)) + 1)`` with unit
    length, as in the long form."""
    cv = count_vectorizer(df, tokens_col, "__tf" if use_idf else out, min_df).fit(df)
    stages = [cv]
    if use_idf:
        counted = cv.transform(df)
        weight = IDF(inputCol="__tf", outputCol="__idf").fit(counted).idf.toArray() + 1.0
        stages += [ElementwiseProduct(scalingVec=Vectors.dense(weight), inputCol="__tf", outputCol="__w"),
                   Normalizer(inputCol="__w", outputCol=out, p=2.0)]
    model = PipelineModel(stages)
    return model.transform(df).drop("__tf", "__w"), model


def train_linear(train: DataFrame, text_col: str, label_col: str, reg: float = 1e-4, max_iter: int = 50,
                 chars: bool = False, use_idf: bool = False) -> PipelineModel:
    """Bag of words (or of characters, for zh / ja), counts or tf-idf -> one-vs-rest linear SVM
    (hinge loss, L2). Labels are 0-based class ids."""
    split = f"split(lower({text_col}), '')" if chars else f"regexp_extract_all(lower({text_col}), '(?U)\\\\b\\\\w\\\\w+\\\\b', 0)"
    tok = SQLTransformer(statement=f"SELECT *, {split} AS __tokens FROM __THIS__")
    tokens = tok.transform(train)
    vectors, features = vectorise(tokens, "__tokens", use_idf=use_idf)
    # the per-class binary models are independent: fit them concurrently
    ovr = OneVsRest(classifier=LinearSVC(regParam=reg, maxIter=max_iter), labelCol=label_col, parallelism=8,
                    featuresCol="features", predictionCol="prediction")
    return PipelineModel([tok, *features.stages, ovr.fit(vectors)])


def dummy_predictions(train: DataFrame, test: DataFrame, label_col: str, id_col: str,
                      strategy: str = "most_frequent", seed: int = 0) -> DataFrame:
    """most_frequent (smallest label of the top count), uniform or stratified (hash-seeded).

    The class table is tiny (one row per class) and is broadcast.
    """
    # The class table has one row per class: collecting it is bounded by the label set.
    classes = sorted((r[0], r[1]) for r in train.groupBy(label_col).agg(F.count(F.lit(1))).collect()
                     if r[0] is not None)
    if not classes:
        return test.withColumn("prediction", F.lit(None))
    if strategy == "most_frequent":
        top = min(classes, key=lambda c: (-c[1], c[0]))[0]
        return test.withColumn("prediction", F.lit(top))
    if strategy == "uniform":
        shares = [1.0 / len(classes)] * len(classes)
    elif strategy == "stratified":
        total = sum(n for _, n in classes)
        shares = [n / total for _, n in classes]
    else:
        raise ValueError(strategy)
    u = (F.conv(F.substring(hash_key(F.lit(seed), F.col(id_col)), 1, 8), 16, 10).cast("double") + 0.5) / float(16 ** 8)
    # cumulative share boundaries, summed in label order; the last class takes the rest
    expr, hi = None, 0.0
    for (label, _), share in zip(classes[:-1], shares[:-1]):
        hi += share
        expr = F.when(u < hi, F.lit(label)) if expr is None else expr.when(u < hi, F.lit(label))
    last = F.lit(classes[-1][0])
    return test.withColumn("prediction", last if expr is None else expr.otherwise(last))


def score_with_model(df: DataFrame, model: PipelineModel, out: str = "prediction") -> DataFrame:
    """M08 with a Spark ML model."""
    return model.transform(df).withColumnRenamed("prediction", out) if out != "prediction" else model.transform(df)


def score_with_udf(df: DataFrame, text_col: str, scorer: Callable, out: str = "label") -> DataFrame:
    """M08 with a user model: ``scorer`` is a pandas UDF (iterator form recommended: the model is
    loaded once per executor and fed Arrow batches)."""
    return df.withColumn(out, scorer(F.col(text_col)))


def lexicon_model(emotions: DataFrame, lang_col: str = "lang") -> DataFrame:
    """A data-derived scorer for the binding: each emotion word votes for its category's polarity
    (joy -> 5 stars, anger / sadness / fear -> 1 star). One row per (lang, word, stars)."""
    pol = gold_from_emotion(F.col("emotion_category"))
    stars = F.when(pol == "positive", F.lit(5)).when(pol == "negative", F.lit(1))
    return (emotions.where(stars.isNotNull() & F.col("emotion_word").isNotNull())
            .select(lang_col, F.lower(F.col("emotion_word")).alias("word"), stars.alias("stars")).distinct())


def score_lexicon(df: DataFrame, text_col: str, lexicon: DataFrame, keys: list[str] | None = None,
                  out: str = "label") -> DataFrame:
    """M08 with the lexicon model: stars = rounded mean of matched word stars, 3 when nothing matches.

    The lexicon (a word sheet) becomes one list of entries for each value of ``keys`` (the language;
    with the run, every run has its own model); every row looks its tokens up in its list, so rows are
    neither exploded nor grouped and equal rows stay apart.
    """
    keys = keys or ["lang"]
    entry = F.struct("word", F.col("stars").cast("double").alias("stars"))
    lists = lexicon.groupBy(*keys).agg(F.collect_list(entry).alias("__lex"))
    hits = F.flatten(F.transform(word_tokens(F.col(text_col)), lambda w: F.transform(
        F.filter("__lex", lambda e: e["word"] == w), lambda e: e["stars"])))
    mean = F.aggregate("__hits", F.lit(0.0), lambda a, x: a + x) / F.size("__hits")
    return df.join(lists, keys, "left").withColumn("__hits", F.coalesce(hits, F.array().cast("array<double>"))).withColumn(
        out, F.when(F.size("__hits") > 0, F.round(mean).cast("int")).otherwise(F.lit(3))).select(*df.columns, out)


def evaluate_scorer(labelled: DataFrame) -> DataFrame:
    """M09 glue: a scored corpus (``label``, ``emotion``) gets the predicted polarity and the gold
    polarity of its emotion (P02 / P03), ready for the nested metrics."""
    return labelled.withColumns({"pred_polarity": polarity(F.col("label")),
                                 "gold_label": gold_from_emotion(F.col("emotion"))})


def encode_pairs(df: DataFrame, id_col: str, first: str, second: str, vocab: DataFrame, max_length: int = 500,
                 cls_id: int = 1, sep_id: int = 2, unk_id: int = 3, pad_id: int = 0) -> DataFrame:
    """``[CLS] first [SEP] second [SEP]`` ids, longest-first truncation to ``max_length``,
    padding, attention mask and segment ids.

    ``vocab(term, id)`` (ids from 4 up; the smaller, the more frequent) is sent to all tasks up to
    ``MOST_SENT_WORDS`` rows, those of the smallest ids. Documents are dealt by id to as many tasks as their
    texts fill and their ids are gathered there in token order; of a larger vocabulary, the terms that
    are left are joined by shuffle, once for each document, and come back to it as a map.
    """
    # posexplode_outer keeps texts without tokens (their marker row has a NULL position)
    budget = max_length - 3
    # Whole texts are tokenised and their full lengths drive the truncation; a segment can keep at
    # most ``budget`` tokens, so positions beyond it cannot reach the output and are not joined.
    segs = F.array(F.struct(F.lit(0).alias("seg"), word_tokens(F.col(first)).alias("toks")),
                   F.struct(F.lit(1).alias("seg"), word_tokens(F.col(second)).alias("toks")))
    parts = parts_of(df, first, second)
    # NULL ids are a document of their own, also where documents are joined: a struct is never NULL
    docs = dealt_by(df.select(F.struct(F.col(id_col).alias("id")).alias("doc"), first, second), parts, "doc")
    toks = docs.select("doc", F.explode(segs).alias("s")).select(
        "doc", F.col("s.seg").alias("seg"), F.size("s.toks").alias("seg_len"),
        F.posexplode_outer(F.slice("s.toks", 1, budget)).alias("pos", "term"))
    n_terms, first_id = vocab.agg(F.count(F.lit(1)), F.min("id")).first()
    large = n_terms > MOST_SENT_WORDS
    common = vocab.where(F.col("id") < first_id + MOST_SENT_WORDS) if large else vocab
    ids = toks.join(F.broadcast(common), "term", "left")
    left = F.when(F.col("id").isNull(), F.col("term")) if large else F.lit(None).cast("string")
    g = ids.groupBy("doc").agg(F.collect_list(F.struct("seg", "pos", "id", left.alias("term"))).alias("t"),
                               F.max(F.when(F.col("seg") == 0, F.col("seg_len"))).alias("la"),
                               F.max(F.when(F.col("seg") == 1, F.col("seg_len"))).alias("lb"))
    found = F.col("t.id")
    if large:
        others = ids.where("id is null and term is not null").select("doc", "term").distinct()
        rest = vocab.where(F.col("id") >= first_id + MOST_SENT_WORDS)
        maps = others.join(rest.hint("merge"), "term").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "id"))).alias("m"))
        g = g.join(maps.hint("merge"), "doc", "left")
        found = F.transform("t", lambda x: F.coalesce(x["id"], F.when(x["term"].isNotNull(), F.try_element_at(F.col("m"), x["term"]))))
    t = F.sort_array(F.zip_with("t", found, lambda x, i: F.struct(x["seg"].alias("seg"), x["pos"].alias("pos"), F.coalesce(i, F.lit(unk_id)).alias("id"))))
    g = g.select(F.col("doc.id").alias(id_col), t.alias("t"), "la", "lb")
    a = F.expr("transform(filter(t, x -> x.seg = 0 AND x.pos IS NOT NULL), x -> x.id)")
    b = F.expr("transform(filter(t, x -> x.seg = 1 AND x.pos IS NOT NULL), x -> x.id)")
    g = g.select(id_col, a.alias("a"), b.alias("b"), "la", "lb")
    la, lb = F.col("la"), F.col("lb")
    short, long_ = F.least(la, lb), F.greatest(la, lb)
    keep_short = F.when(la + lb <= budget, short).when(short <= budget // 2, short).otherwise(F.lit(budget // 2))
    keep_long = F.when(la + lb <= budget, long_).otherwise(F.lit(budget) - keep_short)
    # longest-first removes from the second sequence on equal lengths, so the first keeps the ceiling
    ka = F.when(la > lb, keep_long).when(la < lb, keep_short).otherwise(F.ceil(F.least(la + lb, F.lit(budget)) / 2))
    kb = F.when(la > lb, keep_short).when(la < lb, keep_long).otherwise(F.floor(F.least(la + lb, F.lit(budget)) / 2))
    ka, kb = ka.cast("int"), kb.cast("int")
    seq = F.concat(F.array(F.lit(cls_id)), F.slice("a", 1, ka), F.array(F.lit(sep_id)), F.slice("b", 1, kb),
                   F.array(F.lit(sep_id)))
    n = ka + kb + 3
    pad = F.array_repeat(F.lit(pad_id), F.lit(max_length) - n)
    return g.select(
        id_col,
        F.concat(seq, pad).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n)).alias("attention_mask"),
        F.concat(F.array_repeat(F.lit(0), ka + 2), F.array_repeat(F.lit(1), kb + 1),
                 F.array_repeat(F.lit(0), F.lit(max_length) - n)).alias("token_type_ids"),
    )


def build_vocabulary(term_table: DataFrame, first_id: int = 4, min_count: int = 1) -> DataFrame:
    """Vocabulary ``(term, id)`` by descending corpus frequency, ties by term; exact dense ids from
    positions by range (no single-task global window)."""
    c = term_table.groupBy("term").agg(F.sum("n").alias("cnt")).where(F.col("cnt") >= min_count)
    p = positions(c, [], [F.desc("cnt"), F.col("term")], name="rank")
    return p.select("term", (F.col("rank") + first_id).alias("id"), "cnt")

