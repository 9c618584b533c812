"""Reports of the trained baseline and of items that the main module leaves out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from minpair.functions.labels import effective_lang, relabel_lang
from minpair.operators import bias, corpus, dist, linear, mart, ml, perf, text, vote
from minpair.plans import corpus_parts
from minpair.plans.reports import _baseline, _corpus, _documents, _place, _profiles, _validated, binding_convergence, report, rounded
from minpair.session import materialise
from minpair.sources import tables, views
from minpair.sources.tables import table


# --- trained baseline -----------------------------------------------------------------------------

@report("m05_linear_coefficients")
def linear_coefficients(spark, sf_dir):
    """Coefficients of the trained baseline by class and term, in whole numbers; the empty term is the
    intercept."""
    return _baseline(spark, sf_dir).table()


@report("m07_linear_chars_report")
def linear_chars_report(spark, sf_dir):
    """The baseline over characters weighted by tf-idf (the analyser for zh / ja), report on the others."""
    val = _validated(spark, sf_dir, chars=True, use_idf=True).withColumn("pred_stars", F.col("pred_class") + 1)
    return rounded(perf.classification_report(val, ["split"], "label", "pred_stars", labels=[1, 2, 3, 4, 5]))


@report("p06_class_scores")
def class_scores(spark, sf_dir):
    """Scores of every class, the first largest one (P06) and the stars it stands for (P05), by review."""
    val = _validated(spark, sf_dir)
    return val.select("review_id", "split", "pred_class", (F.col("pred_class") + 1).alias("pred_stars"),
                      F.array_join(F.transform("pred_class_scores", lambda s: s.cast("string")), ",").alias("scores"))


def _trained_scored(spark, sf_dir):
    """The corpus labelled by the trained baseline in Python workers."""
    labelled = linear.score_corpus(corpus.corpus_long(_corpus(spark, sf_dir)), "sentence", _baseline(spark, sf_dir))
    return labelled.withColumn("label", F.col("label") + 1)


@report("m08_trained_labels")
def trained_labels(spark, sf_dir):
    """Stars that the trained baseline gives every sentence of the corpus."""
    return _trained_scored(spark, sf_dir).select("lang", "emotion", "bias_type", "side", "pair_id", "label")


@report("m09_trained_bias")
def trained_bias(spark, sf_dir):
    """Train on reviews, score the corpus, bias statistics by language, bias type and emotion."""
    pairs = vote.align_sides(_trained_scored(spark, sf_dir), ["lang", "emotion", "bias_type", "pair_id"])
    return rounded(bias.bias_stats(pairs, ["lang", "bias_type", "emotion"]))


@report("m09_trained_performance")
def trained_performance(spark, sf_dir):
    """Nested performance of the trained baseline on the corpus against the emotions' gold labels."""
    scored = ml.evaluate_scorer(_trained_scored(spark, sf_dir))
    return rounded(perf.nested_performance(scored, "gold_label", "pred_polarity", "bias_type", "grp"))


# --- distributions of continuous values, large counts -----------------------------------------------

def _events(spark, sf_dir):
    """Events with an even or odd user as the two samples."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return e.withColumn("half", (F.col("user_id") % 2).cast("int"))


@report("a17_wasserstein_events")
def wasserstein_events(spark, sf_dir):
    """Distance between the values of even and odd users by event type, and over all events."""
    e = _events(spark, sf_dir)
    each = dist.wasserstein(e, ["event_type"], "half", "value", 0, 1)
    every = dist.wasserstein(e, [], "half", "value", 0, 1).select(F.lit(None).cast("string").alias("event_type"), "wasserstein")
    return rounded(each.unionByName(every))


@report("a19_five_numbers_events")
def five_numbers_events(spark, sf_dir):
    """Quartiles and whiskers of the values by event type and by the user's half."""
    return rounded(dist.five_numbers(_events(spark, sf_dir), ["event_type", "half"], "value"))


@report("a18_bootstrap_large_counts")
def bootstrap_large_counts(spark, sf_dir):
    """Bootstrap interval of the labels of all runs by step: every cell counts hundreds of rows and more."""
    return rounded(dist.bootstrap_ci(views.votes(spark, sf_dir), ["steps"], "label", replicates=100))


# --- sources and sinks on real files ----------------------------------------------------------------

@report("s02_skipped_files")
def skipped_files(spark, sf_dir):
    """Files by category with one that is no Parquet file, and an expected category without a folder:
    what was read of each, and which were skipped."""
    path = _place(spark, "categories")
    r = views.reviews(spark, sf_dir).select("review_id", "stars", F.col("product_category").alias("category")).where("category is not null")
    r.write.partitionBy("category").parquet(path)
    spark.createDataFrame([("not a parquet file",)], "value string").coalesce(1).write.text(f"{path}/category=broken")
    names = r.select("category").distinct().unionByName(spark.createDataFrame([("broken",), ("absent",)], "category string"))
    return tables.account_categories(spark, path, names, T.StructType([T.StructField("review_id", T.LongType())]))


#: Columns of the sheets, as the files have them.
SHEETS = {
    "templates": ("template_idx int, template string", lambda spark, sf_dir: corpus_parts.templates(spark)),
    "emotions": ("emotion_idx int, emotion_category string, emotion_word string, grammar string, emotion_word_female string",
                 lambda spark, sf_dir: corpus_parts.emotions(spark)),
    "people": ("person_1 string, person_2 string, person_1_type string, person_2_type string, bias_type string, grammar string, "
               "person_idx int", corpus_parts.people),
}


@report("s03_sheets")
def sheets(spark, sf_dir):
    """The three sheets of every language as files, read by type with their headers checked. A third
    language's people sheet has two columns swapped, and every 50th Spanish person has no number."""
    root, out = _place(spark, "sheets"), []
    for kind, (ddl, rows) in SHEETS.items():
        schema = T.StructType.fromDDL(ddl)
        df, path = rows(spark, sf_dir), f"{root}/{kind}"
        cols = [F.col(c).cast("string").alias(c) for c in schema.names]
        if kind == "people":
            odd = (F.col("lang") == "es") & (F.col("person_idx") % 50 == 0)
            cols[-1] = F.when(odd, "n/a").otherwise(F.col("person_idx").cast("string")).alias("person_idx")
            swapped = [schema.names[1], schema.names[0], *schema.names[2:]]
            df.where("lang = 'en'").select(*swapped).write.option("header", "true").csv(f"{path}/lang=pt")
        df.select("lang", *cols).write.mode("append").option("header", "true").partitionBy("lang").csv(path)
        names = schema.names[:6] if kind == "people" else schema.names
        read = tables.read_sheet(spark, path, schema, len(names)).groupBy("lang").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count("rejected").alias("n_rejected"), F.count(schema.names[-1]).alias("n_last"))
        heads = tables.sheet_headers(spark, path, names).groupBy("lang").agg(F.bool_and("header_ok").alias("header_ok"))
        out.append(heads.join(read, "lang", "left").select(F.lit(kind).alias("sheet"), "lang", "header_ok", "n_rows", "n_rejected", "n_last"))
    return reduce(lambda a, b: a.unionByName(b), out)


def output_set(pairs, convergence) -> dict:
    """The eight files of each run (language and seed) from its label pairs: summaries and labels, each
    also by emotion, polarity codes, performance with and without neutral texts, and the summaries at
    the language's convergence step."""
    codes = perf.polarity_frame(pairs)
    keys = ["lang", "seed", "bias_type", "steps"]
    stats = materialise(bias.bias_stats_sets(pairs, keys))
    means = ["bias_cat_1_mean", "bias_cat_2_mean", "performance_gap", "statistical_significance", "bias_cat_1_name", "bias_cat_2_name",
             "bias_type", "steps"]
    summary = stats.where("level = 'all'").select("lang", "seed", *means)
    labels = ["label_1", "label_2", "performance_gap", "bias_cat_1", "bias_cat_2", "bias_type", "steps"]
    scores = ["precision", "recall", "f1", "support", "acc", "bias_cat", "bias_type", "steps"]
    return {
        "summary": summary,
        "summary_emotion": stats.where("level = 'emotion'").select("lang", "seed", *means, "emotion"),
        "labels": pairs.select("lang", "seed", *labels),
        "labels_emotion": pairs.select("lang", "seed", *labels, "emotion"),
        "polarity": codes.select("lang", "seed", F.col("polarity_1_int").alias("label_1"), F.col("polarity_2_int").alias("label_2"),
                                 F.col("polarity_gap").alias("performance_gap"), "bias_cat_1", "bias_cat_2", "bias_type", "steps", "emotion",
                                 "gold_label", "gold_label_int"),
        "performance": perf.side_performance(codes, keys).select("lang", "seed", *scores),
        "performance_binary": perf.side_performance(codes, keys, binary=True).select("lang", "seed", *scores),
        "convergence": mart.convergence_filter(mart.tag(summary, model_type="mono"), convergence).select("lang", "seed", *means),
    }


@report("s10_output_set")
def all_outputs(spark, sf_dir):
    """S10 + S12: all eight outputs of every run in one write, one run written again, all read back: rows, the
    rows counted while writing, and the sum of the last number of each kind."""
    path = _place(spark, "outputs")
    pairs = materialise(vote.seed_pairs(views.votes(spark, sf_dir)))
    outputs = {kind: rounded(df) for kind, df in output_set(pairs, binding_convergence(spark)).items()}
    written = tables.write_outputs(outputs, path, ["lang", "seed"])
    tables.write_outputs({k: df.where((F.col("lang") == "en") & (F.col("seed") == 42)) for k, df in outputs.items()}, path, ["lang", "seed"])
    total = {"summary": "statistical_significance", "summary_emotion": "statistical_significance", "convergence": "bias_cat_1_mean",
             "performance": "acc", "performance_binary": "f1", "polarity": "gold_label_int"}
    out = []
    for kind, df in outputs.items():
        schema = T.StructType([f for f in df.schema.fields if f.name not in ("lang", "seed")] + [df.schema["lang"], df.schema["seed"]])
        back = tables.read_output(spark, path, kind, schema)
        out.append(back.groupBy("lang", "seed").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(total.get(kind, "performance_gap")).cast("double")).alias("total")).select(
            F.lit(kind).alias("kind"), "lang", "seed", "n", "total", F.lit(written[kind]).cast("long").alias("n_written")))
    return rounded(reduce(lambda a, b: a.unionByName(b), out), 4)


# --- text and labels --------------------------------------------------------------------------------

@report("t10_char_tokens")
def char_tokens(spark, sf_dir):
    """T10 by characters (the analyser for zh / ja): their number, and a digest of them in order."""
    d = text.tokens(_documents(spark, sf_dir, "doc_id", "text"), "text", chars=True)
    return d.select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", "|")).alias("digest"))


#: Characters of one script only, as a user's table has them.
SCRIPT_CHARACTERS = [("\u6f22", "traditional"), ("\u570b", "traditional"), ("\u6c49", "simplified"), ("\u56fd", "simplified")]


def _chinese(spark, sf_dir):
    """Documents in some of which letters are written as Han characters: of either script, both, or neither."""
    d = _documents(spark, sf_dir, "doc_id", "text", "lang")
    kinds = {0: "\u6f22\u5b57", 1: "\u6c49\u5b57", 2: "\u570b\u56fd", 3: "\u5b57\u4e2d"}
    written = F.col("text")
    for k, chars in kinds.items():
        written = F.when(F.col("doc_id") % 11 == k, F.translate("text", "ao", chars)).otherwise(written)
    return d.withColumn("text", written)


def _variants(spark, sf_dir, docs):
    table_ = spark.createDataFrame(SCRIPT_CHARACTERS, "char string, variant string")
    return text.chinese_variant(docs, "doc_id", "text", table_)


@report("t05_chinese_variant")
def chinese_variants(spark, sf_dir):
    """Which Chinese script the Han characters of every document belong to."""
    return _variants(spark, sf_dir, _chinese(spark, sf_dir)).select("doc_id", "n_simplified", "n_traditional", "zh_variant")


@report("a24_texts_by_variant")
def texts_by_variant(spark, sf_dir):
    """Documents by detected language; those with Han characters count under a second key, simplified or
    traditional, as well."""
    docs = _chinese(spark, sf_dir)
    det = text.identify_language(docs, "doc_id", "text", _profiles(spark, sf_dir), ["lang"])
    return text.texts_by_language(det.join(_variants(spark, sf_dir, docs).select("doc_id", "zh_variant"), "doc_id"), ["lang"], "zh_variant")


@report("p18_effective_lang")
def effective_langs(spark, sf_dir):
    """P18 + P15: the language of the data that each run is scored on - its own, or the target for the
    multilingual run (seed 0) -, with the scrubbed run (seed 63 in English) under its short name."""
    v = views.votes(spark, sf_dir)
    model = (F.when(F.col("seed") == 0, "multi").when((F.col("seed") == 63) & (F.col("lang") == "en"), "en_scrubbed").otherwise(F.col("lang")))
    v = v.withColumn("model_lang", model).withColumn("data_lang", relabel_lang(effective_lang(F.col("model_lang"), F.col("lang"))))
    return v.groupBy("model_lang", "data_lang").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("label_sum"))


@report("f05_substring_filter")
def substring_filter(spark, sf_dir):
    """F05 as the display script has it: bias types whose name contains a text (``ra``: race and rank)."""
    v = mart.keep_bias_type(views.votes(spark, sf_dir), "ra", substring=True)
    return v.groupBy("bias_type", "lang").agg(F.count(F.lit(1)).alias("n"))
