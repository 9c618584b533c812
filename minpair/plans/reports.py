"""Registered reports: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each report reads the whole driver tables (through the views of ``minpair.sources.views``) and runs
one operator or a short chain of them. Doubles are rounded to 6 places only here, at the report
boundary, so results compare across engines; the operators themselves keep full precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minpair.functions.labels import stars_to_class
from minpair.functions.ranking import hash_key
from minpair.operators import bias, vote
from minpair.plans import dims
from minpair.sources import views

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def report(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


N_SEEDS = len(dims.SEEDS)


def _ensemble(spark, sf_dir):
    return vote.ensemble_pairs(views.votes(spark, sf_dir), n_seeds=N_SEEDS)


# --- flagship and bias statistics --------------------------------------------------------------

@report("a04_ensemble_bias_by_emotion")
def ensemble_bias_by_emotion(spark, sf_dir):
    """Flagship: gap, means, t and p by language, bias type, emotion and step for the 5-seed
    majority-vote ensemble (votes -> A06 -> J06 -> A04)."""
    pairs = _ensemble(spark, sf_dir)
    return rounded(bias.bias_stats(pairs, ["lang", "bias_type", "emotion", "steps"]))


@report("a03_ensemble_bias")
def ensemble_bias(spark, sf_dir):
    pairs = _ensemble(spark, sf_dir)
    return rounded(bias.bias_stats(pairs, ["lang", "bias_type", "steps"]))


@report("a03_bias_per_seed")
def bias_per_seed(spark, sf_dir):
    """Per-run summary (one row per seed, step and bias type)."""
    pairs = vote.seed_pairs(views.votes(spark, sf_dir))
    return rounded(bias.bias_stats(pairs, ["lang", "seed", "bias_type", "steps"]))


@report("a04_bias_per_seed_by_emotion")
def bias_per_seed_by_emotion(spark, sf_dir):
    pairs = vote.seed_pairs(views.votes(spark, sf_dir))
    return rounded(bias.bias_stats(pairs, ["lang", "seed", "bias_type", "emotion", "steps"]))


@report("a05_seed_mean_bias")
def seed_mean_bias(spark, sf_dir):
    pairs = vote.mean_pairs(views.votes(spark, sf_dir))
    return rounded(bias.bias_stats(pairs, ["lang", "bias_type", "steps"]))


@report("a01_paired_ttest_events")
def paired_ttest_events(spark, sf_dir):
    """A01 on another table: per event type, the paired difference between a user's mean value in
    the first and the second half of the time range (users present in both halves)."""
    from minpair.sources.tables import table
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "value")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = ev.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()  # one row
    mid = F.lit((span["lo"] + span["hi"]) // 2 if span["lo"] is not None else 0)
    half = F.when(at < mid, F.lit(1)).otherwise(F.lit(2))
    per_user = ev.groupBy("event_type", "user_id").agg(
        F.avg(F.when(half == 1, F.col("value"))).alias("label_1"),
        F.avg(F.when(half == 2, F.col("value"))).alias("label_2"))
    return rounded(bias.paired_ttest(per_user, ["event_type"]))


# --- votes -----------------------------------------------------------------------------------------

@report("a06_majority_vote")
def majority_vote(spark, sf_dir):
    keys = ["lang", "steps", "bias_type", "emotion", "side", "pair_id"]
    return vote.vote_items(views.votes(spark, sf_dir), keys)


@report("a06_majority_vote_median")
def majority_vote_median(spark, sf_dir):
    keys = ["lang", "steps", "bias_type", "emotion", "side", "pair_id"]
    return vote.vote_items(views.votes(spark, sf_dir), keys, tie="median")


@report("j06_ensemble_pairs")
def ensemble_pairs(spark, sf_dir):
    """Label-level ensemble file: one row per pair, step and emotion."""
    return _ensemble(spark, sf_dir)


@report("a08_disagreements")
def disagreements(spark, sf_dir):
    keys = ["lang", "steps", "bias_type", "emotion", "side", "pair_id", "grp"]
    voted = vote.vote_items(views.votes(spark, sf_dir), keys)
    return rounded(vote.disagreement_stats(voted, ["bias_type", "grp", "steps"]))


@report("t12_parse_vote_log")
def parse_vote_log(spark, sf_dir):
    keys = ["lang", "steps", "bias_type", "emotion", "side", "pair_id"]
    voted = vote.vote_items(views.votes(spark, sf_dir), keys)
    return vote.parse_vote_log(vote.render_vote_log(voted))


@report("a26_vote_log_shares")
def vote_log_shares(spark, sf_dir):
    keys = ["lang", "steps", "bias_type", "emotion", "side", "pair_id"]
    voted = vote.vote_items(views.votes(spark, sf_dir), keys)
    return rounded(vote.vote_log_shares(vote.parse_vote_log(vote.render_vote_log(voted))))


@report("a26_tie_ranking")
def tie_ranking(spark, sf_dir):
    keys = ["lang", "steps", "bias_type", "emotion", "side", "pair_id"]
    voted = vote.vote_items(views.votes(spark, sf_dir), keys)
    return vote.tie_ranking(vote.parse_vote_log(vote.render_vote_log(voted)))


@report("j12_missing_groups")
def missing_groups(spark, sf_dir):
    """Catalogue groups with no predictions, per language and step (fr has no catalogue entry,
    the inner catalogue join leaves it out). The German run at the last step lost its second gender
    group, which is what the report has to find."""
    v = views.votes(spark, sf_dir)
    v = v.where(~((F.col("lang") == "de") & (F.col("steps") == max(dims.STEPS)) & (F.col("bias_type") == "gender") & (F.col("side") == 2)))
    return bias.missing_groups(v, dims.bias_sides(spark), ["lang", "steps"])


# --- performance ------------------------------------------------------------------------------------

from minpair.operators import perf  # noqa: E402
from minpair.sources.tables import table  # noqa: E402

POLARITY_COLS = ["lang", "steps", "bias_type", "emotion", "pair_id", "bias_cat_1", "bias_cat_2", "label_1",
                 "label_2", "polarity_1", "polarity_2", "gold_label", "gold_label_int", "polarity_1_int",
                 "polarity_2_int", "polarity_gap"]


def _polarity(spark, sf_dir):
    return perf.polarity_frame(_ensemble(spark, sf_dir))


@report("p08_polarity_labels")
def polarity_labels(spark, sf_dir):
    return _polarity(spark, sf_dir).select(*POLARITY_COLS)


@report("a10_side_performance")
def side_performance(spark, sf_dir):
    return rounded(perf.side_performance(_polarity(spark, sf_dir), ["lang", "bias_type", "steps"]))


@report("a10_side_performance_binary")
def side_performance_binary(spark, sf_dir):
    return rounded(perf.side_performance(_polarity(spark, sf_dir), ["lang", "bias_type", "steps"], binary=True))


@report("a11_nested_performance")
def nested_performance(spark, sf_dir):
    pf = _polarity(spark, sf_dir)
    long = perf.sides_long(pf, ["lang", "bias_type", "steps"], "polarity_1", "polarity_2", extra=["gold_label"])
    return rounded(perf.nested_performance(long, "gold_label", "pred", "bias_type", "bias_cat"))


def _labels_by_lang(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("gold"), F.col("toxic").alias("pred"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return lab.join(docs, "doc_id")


@report("a09_label_metrics")
def label_metrics(spark, sf_dir):
    return rounded(perf.classification_metrics(_labels_by_lang(spark, sf_dir), ["lang"], "gold", "pred"))


@report("a12_classification_report")
def classification_report(spark, sf_dir):
    return rounded(perf.classification_report(_labels_by_lang(spark, sf_dir), ["lang"], "gold", "pred", labels=[0, 1]))


@report("a12_star_report")
def star_report(spark, sf_dir):
    """Report of side-1 ensemble stars against side-2 stars with the fixed class list 1..5."""
    pairs = _ensemble(spark, sf_dir)
    return rounded(perf.classification_report(pairs, ["lang"], "label_2", "label_1", labels=[1, 2, 3, 4, 5]))


@report("a13_confusion_matrix")
def confusion_matrix(spark, sf_dir):
    pairs = _ensemble(spark, sf_dir)
    return perf.confusion_matrix(pairs, ["lang", "bias_type", "steps"], "label_1", "label_2", [1, 2, 3, 4, 5])


@report("a14_confusion_difference")
def confusion_difference(spark, sf_dir):
    """Gold-vs-prediction confusion of side 1 minus that of side 2 (polarity scale 0..2)."""
    pf = _polarity(spark, sf_dir)
    sides = F.array(F.struct(F.col("polarity_1_int").alias("p"), F.lit(1).alias("w")),
                    F.struct(F.col("polarity_2_int").alias("p"), F.lit(-1).alias("w")))
    long = pf.select("bias_type", "steps", "gold_label_int", F.explode(sides).alias("s")).select(
        "bias_type", "steps", "gold_label_int", F.col("s.p").alias("polarity_1_int"), F.col("s.w").alias("w"))
    return perf.weighted_confusion(long, ["bias_type", "steps"], "gold_label_int", "polarity_1_int", "w", [0, 1, 2])


@report("a15_confusion_zero_diagonal")
def confusion_zero_diagonal(spark, sf_dir):
    pairs = _ensemble(spark, sf_dir)
    cm = perf.confusion_matrix(pairs, ["lang", "bias_type", "steps"], "label_1", "label_2", [1, 2, 3, 4, 5])
    return perf.zero_diagonal(cm)


def _two_models(spark, sf_dir):
    v = views.votes(spark, sf_dir, seeds=[s for s in dims.SEEDS if s[0] in (0, 63)])
    keys = ["lang", "steps", "bias_type", "emotion", "side", "pair_id"]
    a = v.where(F.col("seed") == 0)
    b = v.where(F.col("seed") == 63)
    return perf.align_results(a, b, keys)


@report("a32_model_agreement")
def model_agreement(spark, sf_dir):
    """Agreement matrix of two runs (seed 0 rows, seed 63 columns) aligned by item (J10 + A13)."""
    return perf.confusion_matrix(_two_models(spark, sf_dir), ["lang", "steps"], "label_a", "label_b", [1, 2, 3, 4, 5])


@report("a32_model_agreement_report")
def model_agreement_report(spark, sf_dir):
    return rounded(perf.classification_report(_two_models(spark, sf_dir), ["lang", "steps"], "label_a", "label_b",
                                              labels=[1, 2, 3, 4, 5]))


# --- distributions ----------------------------------------------------------------------------------

from minpair.operators import dist  # noqa: E402


def _stacked(spark, sf_dir):
    return dist.stack_columns(_ensemble(spark, sf_dir), ["lang", "bias_type", "steps", "pair_id"],
                              ["label_1", "label_2"], name="label", tag="source")


@report("u06_stack_labels")
def stack_labels(spark, sf_dir):
    return _stacked(spark, sf_dir)


@report("a16_label_distribution")
def label_distribution(spark, sf_dir):
    return rounded(dist.label_distribution(_stacked(spark, sf_dir), ["lang", "bias_type", "steps", "source"], "label"))


@report("a17_wasserstein")
def wasserstein(spark, sf_dir):
    """Distance between the label distributions of the two sides, per language, bias type, step."""
    return rounded(dist.wasserstein(_stacked(spark, sf_dir), ["lang", "bias_type", "steps"], "source", "label",
                                    "label_1", "label_2"))


@report("a17_wasserstein_seeds")
def wasserstein_seeds(spark, sf_dir):
    """Distance between the label distributions of two runs (seed 0 vs seed 63) per language."""
    v = views.votes(spark, sf_dir, seeds=[s for s in dims.SEEDS if s[0] in (0, 63)])
    return rounded(dist.wasserstein(v, ["lang", "steps"], "seed", "label", 0, 63))


@report("a19_five_numbers")
def five_numbers(spark, sf_dir):
    return rounded(dist.five_numbers(_ensemble(spark, sf_dir), ["bias_type", "steps"], "performance_gap"))


@report("a21_point_counts")
def point_counts(spark, sf_dir):
    """Identical (run, gap) points: bubble sizes of the per-seed gap scatter."""
    return dist.point_counts(vote.seed_pairs(views.votes(spark, sf_dir)), ["seed", "bias_type"], "performance_gap")


@report("a22_min_max")
def min_max(spark, sf_dir):
    """Range of the per-run summary gaps per bias type (over all seeds, steps, languages)."""
    pairs = vote.seed_pairs(views.votes(spark, sf_dir))
    per_run = bias.bias_stats(pairs, ["lang", "seed", "bias_type", "steps"])
    return rounded(dist.min_max(per_run, ["bias_type"], "performance_gap"))


@report("a18_normal_ci")
def normal_ci(spark, sf_dir):
    return rounded(dist.normal_ci(_ensemble(spark, sf_dir), ["lang", "bias_type", "steps"], "performance_gap"))


@report("a18_bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    """Bootstrap interval whose draws come from hashes, so that SQL repeats them."""
    return rounded(dist.bootstrap_ci(_ensemble(spark, sf_dir), ["lang", "bias_type", "steps"], "performance_gap",
                                     replicates=200))


@report("a20_kde_density")
def kde_density(spark, sf_dir):
    return rounded(dist.kde_density(_ensemble(spark, sf_dir), ["bias_type", "steps"], "performance_gap"))


# --- corpus -------------------------------------------------------------------------------------------

from minpair.operators import corpus  # noqa: E402
from minpair.plans import corpus_parts  # noqa: E402


def _sentences(spark):
    return corpus.fill_emotions(corpus_parts.templates(spark), corpus_parts.emotions(spark), dims.grammar_catalogue(spark))


def _corpus(spark, sf_dir):
    return corpus.build_corpus(corpus_parts.templates(spark), corpus_parts.emotions(spark),
                               corpus_parts.people(spark, sf_dir), dims.grammar_catalogue(spark))


@report("j01_fill_emotions")
def fill_emotions(spark, sf_dir):
    """Emotion expansion of the templates, with the number of candidate pairs each sentence yields
    against the person pairs from ``customer`` (so the report's work grows with the data)."""
    s = _sentences(spark)
    cand = corpus.fill_people(s, corpus_parts.people(spark, sf_dir), dims.grammar_catalogue(spark))
    keys = ["lang", "emotion", "e_grammar_idx", "template_idx", "emotion_idx"]
    n = cand.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_candidates"))
    out = s.join(n, keys, "left").fillna(0, subset=["n_candidates"])
    return out.select(*keys, "text", F.col("variants")["male"].alias("text_male"),
                      F.col("variants")["female"].alias("text_female"), "n_candidates")


@report("j02_fill_people")
def fill_people(spark, sf_dir):
    """Candidate pairs before de-duplication (sentences x person pairs of the same grammar)."""
    return corpus.fill_people(_sentences(spark), corpus_parts.people(spark, sf_dir), dims.grammar_catalogue(spark))


@report("u04_dedupe_pairs")
def dedupe_pairs(spark, sf_dir):
    """The corpus: first-wins de-duplicated pairs with dense pair ids."""
    return _corpus(spark, sf_dir)


@report("a25_corpus_sizes")
def corpus_sizes(spark, sf_dir):
    return corpus.corpus_sizes(_corpus(spark, sf_dir))


@report("a30_validate_pairs")
def validate_pairs(spark, sf_dir):
    """Slices whose sides differ, in a corpus that lost every third second side of the joyful pairs."""
    long = corpus.corpus_long(_corpus(spark, sf_dir))
    return corpus.validate_pairs(long.where(~((F.col("emotion") == "joy") & (F.col("side") == 2) & (F.col("pair_id") % 3 == 0))))


@report("w01_first_sentences")
def first_sentences(spark, sf_dir):
    return corpus.corpus_long(corpus.first_sentences(_corpus(spark, sf_dir), 11))


# --- review preparation ------------------------------------------------------------------------------

from minpair.operators import prep  # noqa: E402


def _english(spark, sf_dir):
    return views.reviews(spark, sf_dir).where(F.col("language") == "en")


@report("p01_format_data")
def format_data(spark, sf_dir):
    return prep.format_data(views.reviews(spark, sf_dir)).select("review_id", "text", "label")


@report("t01_scrub_reviews")
def scrub_reviews(spark, sf_dir):
    """Gender-word scrubbing of English reviews (body and title) with replacement counts."""
    s = prep.scrub_reviews(_english(spark, sf_dir))
    return s.select("review_id", "review_body", "review_title", "n_scrub_body", "n_scrub_title", "n_scrubbed")


@report("t01_scrub_counts")
def scrub_counts(spark, sf_dir):
    """A27 per product category: rows changed, total and maximum replacements."""
    return prep.scrub_stats(prep.scrub_reviews(_english(spark, sf_dir)), ["product_category"])


@report("a28_class_counts")
def class_counts(spark, sf_dir):
    return rounded(prep.class_counts(views.reviews(spark, sf_dir), "stars", ["language"]))


@report("m01_balance_classes")
def balance_classes(spark, sf_dir):
    """Every star class undersampled to the smallest one (seeded hash order)."""
    return prep.balance_classes(views.reviews(spark, sf_dir), "stars", "review_id", seed=42).select(
        "review_id", "language", "stars")


@report("m02_split")
def split(spark, sf_dir):
    return prep.split_by_hash(views.reviews(spark, sf_dir), "review_id", seed=42).select("review_id", "stars", "split")


@report("m02_split_exact")
def split_exact(spark, sf_dir):
    return prep.split_exact(views.reviews(spark, sf_dir).select("review_id", "stars"), "review_id", seed=42)


def _source_idx():
    return F.regexp_extract(F.col("source"), r"src(\d+)", 1).cast("int")


@report("u08_interleave")
def interleave(spark, sf_dir):
    from minpair.sources.tables import table as _t
    d = _t(spark, sf_dir, "documents").select("doc_id", "source")
    return prep.interleave(d, "source", _source_idx(), "doc_id")


@report("w05_first_rows")
def first_rows(spark, sf_dir):
    s = prep.split_by_hash(views.reviews(spark, sf_dir).select("review_id", "stars"), "review_id", seed=42)
    return prep.first_rows(s, ["split"], "review_id", 1000)


@report("w06_seeded_shuffle")
def seeded_shuffle(spark, sf_dir):
    s = prep.split_by_hash(views.reviews(spark, sf_dir).select("review_id", "stars"), "review_id", seed=42)
    return prep.seeded_shuffle(s, ["split"], "review_id", seed=7)


def category_mapping(spark):
    """Mapping dimension for the driver binding: source k -> cat(k % 6), none when k % 6 == 0,
    uncertain when k % 5 == 0 (a rule, 20 rows)."""
    k = F.col("id")
    return spark.range(20).select(
        F.concat(F.lit("src"), k.cast("string")).alias("source_category"),
        F.when(k % 6 == 0, F.lit(None)).otherwise(F.concat(F.lit("cat"), (k % 6).cast("string"))).alias("target_category"),
        (k % 5 == 0).alias("uncertain"))


@report("j11_category_mapping")
def map_categories(spark, sf_dir):
    r = views.reviews(spark, sf_dir).select("review_id", "product_category")
    return prep.map_categories(r, category_mapping(spark), "product_category")


# --- result marts ----------------------------------------------------------------------------------

from minpair.operators import mart  # noqa: E402

# Driver binding: each seed of the vote table plays one model type.
SEED_MODEL_TYPE = {0: "baseline", 5: "mono", 26: "multi_xl", 42: "mono_c", 63: "multi_on_mono"}


def binding_convergence(spark):
    """Convergence catalogue for the binding steps (per-language kinds and one shared kind)."""
    rows = []
    for lang in ["en", "fr", "de", "es"]:
        rows.append(("mono", lang, 33334 if lang in ("en", "fr") else 50001))
        rows.append(("mono_c", lang, 50001))
        rows.append(("multi_on_mono", lang, 33334))
    rows.append(("multi_xl", None, 50001))
    return spark.createDataFrame(rows, "model_type string, lang string, steps int")


def _model_type():
    expr = None
    for s, t in SEED_MODEL_TYPE.items():
        expr = F.when(F.col("seed") == s, F.lit(t)) if expr is None else expr.when(F.col("seed") == s, F.lit(t))
    return expr


def _label_results(spark, sf_dir):
    pairs = vote.seed_pairs(views.votes(spark, sf_dir))
    return pairs.withColumn("model_type", _model_type())


def _mart(spark, sf_dir):
    m = mart.convergence_filter(_label_results(spark, sf_dir), binding_convergence(spark))
    m = mart.relabel(mart.drop_bias_type(m))
    return mart.with_type_order(mart.with_direction(m), dims.model_type_order(spark))


@report("s07_result_mart")
def result_mart(spark, sf_dir):
    return _mart(spark, sf_dir).select("model_type", "type_order", "lang", "bias_type", "emotion", "steps", "pair_id",
                                       "label_1", "label_2", "performance_gap", "bias_direction",
                                       "performance_gap_abs")


@report("j04_converged_summaries")
def converged_summaries(spark, sf_dir):
    """Per-run summaries kept at each model type's convergence step."""
    summ = bias.bias_stats(_label_results(spark, sf_dir), ["model_type", "lang", "bias_type", "steps"])
    return rounded(mart.convergence_filter(summ, binding_convergence(spark)))


@report("p11_significance_flags")
def significance_flags(spark, sf_dir):
    summ = bias.bias_stats(_label_results(spark, sf_dir), ["model_type", "lang", "bias_type", "emotion", "steps"])
    # Flags are taken on the reported (rounded) values, as a reader of the result files would.
    return rounded(mart.significance_flags(rounded(summ)).select(
        "model_type", "lang", "bias_type", "emotion", "steps", "performance_gap", "statistical_significance",
        "significant", "not_significant", "significant_corrected", "within_band"))


@report("a29_mono_vs_multi")
def mono_vs_multi(spark, sf_dir):
    """Paired test of per-item gaps, mono vs multilingual model, per language and bias type."""
    return rounded(mart.paired_model_test(_mart(spark, sf_dir), "mono", "multi_xl", ["lang", "bias_type"],
                                          ["emotion", "pair_id"]))


@report("a31_performance_curve")
def performance_curve(spark, sf_dir):
    lr = perf.polarity_frame(_label_results(spark, sf_dir))
    p = perf.side_performance(lr, ["lang", "model_type", "bias_type", "steps"])
    return rounded(mart.performance_curve(p, ["lang", "model_type", "bias_type", "side", "bias_cat"]))


@report("a14_language_difference")
def language_difference(spark, sf_dir):
    """Side-1 vs side-2 confusion of English minus German ensemble labels, per bias type and step."""
    e = _ensemble(spark, sf_dir).where(F.col("lang").isin("en", "de"))
    signed = e.withColumn("w", F.when(F.col("lang") == "en", F.lit(1)).otherwise(F.lit(-1)))
    return perf.weighted_confusion(signed, ["bias_type", "steps"], "label_1", "label_2", "w", [1, 2, 3, 4, 5])


@report("s10_results_roundtrip")
def results_roundtrip(spark, sf_dir):
    """Per-run summaries written as CSV partitioned by language and seed under the shared
    checkpoint folder, then read back with the fixed schema (NaN -> NULL)."""
    import uuid
    from minpair.session import shared_path
    from minpair.sources import tables
    summ = bias.bias_stats(vote.seed_pairs(views.votes(spark, sf_dir)), ["lang", "seed", "bias_type", "steps"])
    path = shared_path(spark, f"results-{uuid.uuid4().hex}")
    out = summ.select("bias_cat_1_mean", "bias_cat_2_mean", "performance_gap", "statistical_significance",
                      "bias_cat_1_name", "bias_cat_2_name", "bias_type", "steps", "lang", "seed")
    tables.write_result_csv(out, path, partition_by=["lang", "seed"])
    schema = T.StructType(tables.SUMMARY_SCHEMA.fields + [T.StructField("seed", T.IntegerType())])
    back = tables.read_result_csv(spark, path, schema).drop("source_file")
    return rounded(back)


# --- text and models ---------------------------------------------------------------------------------

from minpair.operators import linear, ml, text  # noqa: E402


def _documents(spark, sf_dir, *cols):
    from minpair.sources.tables import table as _t
    return _t(spark, sf_dir, "documents").select(*cols)


@report("t03_normalise")
def normalise(spark, sf_dir):
    return text.normalise(_documents(spark, sf_dir, "doc_id", "text"), "text").select("doc_id", "normalised")


@report("t10_word_tokens")
def word_tokens(spark, sf_dir):
    d = text.tokens(_documents(spark, sf_dir, "doc_id", "text"), "text")
    return d.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@report("m03_term_counts")
def term_counts(spark, sf_dir):
    return ml.term_counts(_documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text")


@report("m04_tfidf")
def tfidf(spark, sf_dir):
    return rounded(ml.tfidf(_documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text"))


def _profiles(spark, sf_dir):
    return text.trigram_profiles(_documents(spark, sf_dir, "text", "lang"), "text", "lang")


@report("t04_identify_language")
def identify_language(spark, sf_dir):
    """Trigram language profiles learnt from the documents, applied to every document."""
    det = text.identify_language(_documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", _profiles(spark, sf_dir))
    return rounded(det.select("doc_id", "detected_lang", F.round("score", 3).alias("score")))


@report("a24_texts_by_language")
def texts_by_language(spark, sf_dir):
    """Conversation turns by role and detected language (rollup totals)."""
    from minpair.sources.tables import table as _t
    conv = _t(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("tid"), "role", "text")
    det = text.identify_language(conv, "tid", "text", _profiles(spark, sf_dir), ["role"])
    return text.texts_by_language(det, ["role"])


@report("t05_script_flags")
def script_flags(spark, sf_dir):
    """Texts with Han characters by language; in every seventh document some letters are written in
    them."""
    d = _documents(spark, sf_dir, "doc_id", "text", "lang").withColumn(
        "text", F.when(F.col("doc_id") % 7 == 0, F.translate("text", "aeo", "\u6f22\u5b57\u56fd")).otherwise(F.col("text")))
    d = text.script_flags(d, "text")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("has_han").alias("n_han"))


def _review_splits(spark, sf_dir):
    r = prep.format_data(views.reviews(spark, sf_dir))
    r = r.withColumn("class_id", stars_to_class(F.col("label")).cast("double"))
    return prep.split_by_hash(r, "review_id", seed=42)


@report("m06_dummy_most_frequent")
def dummy_most_frequent(spark, sf_dir):
    s = _review_splits(spark, sf_dir)
    pred = ml.dummy_predictions(s.where(F.col("split") == "train"), s.where(F.col("split") != "train"),
                                "label", "review_id", "most_frequent")
    return pred.select("review_id", "split", "label", "prediction")


@report("m06_dummy_stratified")
def dummy_stratified(spark, sf_dir):
    s = _review_splits(spark, sf_dir)
    pred = ml.dummy_predictions(s.where(F.col("split") == "train"), s.where(F.col("split") != "train"),
                                "label", "review_id", "stratified", seed=3)
    return pred.select("review_id", "split", "label", "prediction")


#: Rounds of the trained baselines.
ROUNDS = 6


def _baseline(spark, sf_dir, **kw):
    """M05 on the train split of the reviews; classes are 0-based ids."""
    s = _review_splits(spark, sf_dir).withColumn("class_id", F.col("class_id").cast("int"))
    return linear.train(s.where(F.col("split") == "train"), "review_id", "text", "class_id", rounds=ROUNDS, **kw)


def _validated(spark, sf_dir, **kw):
    """The reviews that were held out, with the model's scores and class."""
    s = _review_splits(spark, sf_dir).where(F.col("split") != "train").select("review_id", "split", "label", "text")
    return linear.predict(s, "review_id", "text", _baseline(spark, sf_dir, **kw), "pred_class")


@report("m07_linear_baseline_report")
def linear_baseline_report(spark, sf_dir):
    """M05 + M07: bag-of-words one-vs-rest hinge loss trained on the train split, report on the others."""
    val = _validated(spark, sf_dir).withColumn("pred_stars", F.col("pred_class") + 1)
    return rounded(perf.classification_report(val, ["split"], "label", "pred_stars", labels=[1, 2, 3, 4, 5]))


@report("m07_linear_baseline_support")
def linear_baseline_support(spark, sf_dir):
    """The exact part of the trained model's report: its rows and their supports, which depend on the
    split and the gold labels only."""
    return linear_baseline_report(spark, sf_dir).select("split", "row", "support")


def _lexicon_scored(spark, sf_dir):
    c = corpus.corpus_long(_corpus(spark, sf_dir))
    lex = ml.lexicon_model(corpus_parts.emotions(spark))
    return ml.score_lexicon(c, "sentence", lex)


@report("m09_corpus_bias")
def corpus_bias(spark, sf_dir):
    """The corpus scored by a lexicon model learnt from the emotion sheet; bias statistics per
    language, bias type and emotion (J08 + M08 + J06 + A04)."""
    scored = _lexicon_scored(spark, sf_dir)
    pairs = vote.align_sides(scored, ["lang", "emotion", "bias_type", "pair_id"])
    return rounded(bias.bias_stats(pairs, ["lang", "bias_type", "emotion"]))


@report("m09_corpus_performance")
def corpus_performance(spark, sf_dir):
    """Nested performance of the lexicon scorer against the emotion gold labels."""
    scored = ml.evaluate_scorer(_lexicon_scored(spark, sf_dir))
    return rounded(perf.nested_performance(scored, "gold_label", "pred_polarity", "bias_type", "grp"))


@report("t11_encode_pairs")
def encode_pairs(spark, sf_dir):
    """Body / title pairs of the reviews encoded to 500 ids with mask and segments (vocabulary
    built from the same reviews)."""
    r = views.reviews(spark, sf_dir).select("review_id", "review_body", "review_title")
    tc = ml.term_counts(r.select("review_id", F.concat_ws(" ", "review_body", "review_title").alias("t")),
                        "review_id", "t")
    vocab = ml.build_vocabulary(tc).select("term", "id")
    enc = ml.encode_pairs(r, "review_id", "review_body", "review_title", vocab)
    return enc.select("review_id", F.array_join("input_ids", " ").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_attended"),
                      F.aggregate("token_type_ids", F.lit(0), lambda a, x: a + x).alias("n_second"))


# --- nearest words ------------------------------------------------------------------------------------

from minpair.operators import neighbors  # noqa: E402


def _seed_words(spark, sf_dir):
    """Seeds of the binding: one prototype word per embedding label (the lowest id of each)."""
    wv = views.word_vectors(spark, sf_dir)
    return wv.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select(
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"))


@report("w02_nearest_words")
def nearest_words(spark, sf_dir):
    wv = views.word_vectors(spark, sf_dir).select("word", "vector")
    nn = neighbors.nearest_words(wv, _seed_words(spark, sf_dir), k=20)
    return rounded(nn)


@report("u09_neighbour_set")
def neighbour_set(spark, sf_dir):
    wv = views.word_vectors(spark, sf_dir).select("word", "vector")
    return neighbors.neighbour_set(neighbors.nearest_words(wv, _seed_words(spark, sf_dir), k=20))


# --- remaining statistics ------------------------------------------------------------------------

@report("a23_mean_labels")
def mean_labels(spark, sf_dir):
    """Mean predicted label per group, and per group and emotion, for every run and step."""
    return rounded(bias.mean_labels(views.votes(spark, sf_dir), ["lang", "seed", "steps"]))


@report("j05_catalogue_sides")
def catalogue_sides(spark, sf_dir):
    """Predictions keyed by group name get bias type and side from the catalogue (languages without
    a catalogue entry drop out); counts per language, bias type and side."""
    v = views.votes(spark, sf_dir).select("lang", "grp", "label")
    j = bias.attach_sides(v, dims.bias_sides(spark))
    return j.groupBy("lang", "bias_type", "side").agg(F.count(F.lit(1)).alias("n"),
                                                      F.sum("label").cast("bigint").alias("label_sum"))


@report("a03_a04_grouping_sets")
def grouping_sets(spark, sf_dir):
    """Overall and per-emotion ensemble statistics in one grouping-set aggregation."""
    return rounded(bias.bias_stats_sets(_ensemble(spark, sf_dir), ["lang", "bias_type", "steps"]))


@report("j08_scored_runs")
def scored_runs(spark, sf_dir):
    """The corpus scored by every run of the registry with the run's own model, label counts per run.
    A run's lexicon is the three quarters of the sheet that a hash of run and word gives it."""
    runs = [(s, r, st) for s, r in dims.SEEDS for st in dims.STEPS]
    lex = corpus.each_run(ml.lexicon_model(corpus_parts.emotions(spark)), runs)
    lex = lex.where(F.substring(hash_key("seed", "steps", "word"), 1, 1) < "c")
    long = corpus.each_run(corpus.corpus_long(_corpus(spark, sf_dir)), runs)
    scored = ml.score_lexicon(long, "sentence", lex, ["lang", "seed", "steps"])
    return scored.groupBy("seed", "steps", "lang", "label").agg(F.count(F.lit(1)).alias("n"))


@report("a11_emotion_group_performance")
def emotion_group_performance(spark, sf_dir):
    """Performance of the corpus scorer by (emotion, group), by emotion and overall."""
    scored = ml.evaluate_scorer(_lexicon_scored(spark, sf_dir))
    return rounded(perf.nested_performance(scored, "gold_label", "pred_polarity", "emotion", "grp"))


@report("s11_overall_results_roundtrip")
def overall_results_roundtrip(spark, sf_dir):
    """Overall summaries of both averaging modes (seed mean, majority-vote ensemble) written as one
    CSV dataset partitioned by ``averaging`` under the shared checkpoint folder, read back."""
    import uuid
    from minpair.session import shared_path
    from minpair.sources import tables
    v = views.votes(spark, sf_dir)
    keys = ["lang", "bias_type", "steps"]
    cols = ["bias_cat_1_mean", "bias_cat_2_mean", "performance_gap", "statistical_significance",
            "bias_cat_1_name", "bias_cat_2_name", "bias_type", "steps", "lang"]
    mean = bias.bias_stats(vote.mean_pairs(v), keys).select(*cols, F.lit("overall").alias("averaging"))
    ens = bias.bias_stats(vote.ensemble_pairs(v, n_seeds=N_SEEDS), keys).select(*cols, F.lit("ensemble").alias("averaging"))
    path = shared_path(spark, f"overall-{uuid.uuid4().hex}")
    tables.write_result_csv(mean.unionByName(ens), path, partition_by=["averaging"])
    schema = T.StructType(tables.SUMMARY_SCHEMA.fields + [T.StructField("averaging", T.StringType())])
    return rounded(tables.read_result_csv(spark, path, schema).drop("source_file"))


@report("u01_union_results")
def union_results(spark, sf_dir):
    """Per-run summaries and ensemble summaries appended by column name (the ensemble files have no
    ``seed`` column: NULL there), each tagged with its averaging kind (U01 + P16)."""
    v = views.votes(spark, sf_dir)
    keys = ["lang", "bias_type", "steps"]
    per_run = mart.tag(bias.bias_stats(vote.seed_pairs(v), ["lang", "seed", "bias_type", "steps"]), averaging="run")
    ens = mart.tag(bias.bias_stats(vote.ensemble_pairs(v, n_seeds=N_SEEDS), keys), averaging="ensemble")
    return rounded(mart.union_results([per_run, ens]))


@report("m06_dummy_uniform")
def dummy_uniform(spark, sf_dir):
    s = _review_splits(spark, sf_dir)
    pred = ml.dummy_predictions(s.where(F.col("split") == "train"), s.where(F.col("split") != "train"),
                                "label", "review_id", "uniform", seed=11)
    return pred.select("review_id", "split", "label", "prediction")


# --- sources and sinks as round trips through the shared folder ---------------------------------------

def _place(spark, name):
    import uuid
    from minpair.session import shared_path
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


@report("s01_reviews_roundtrip")
def reviews_roundtrip(spark, sf_dir):
    """S13 + S01: prepared reviews saved by language and split; the English training part read back."""
    from minpair.sources import tables
    path = _place(spark, "reviews")
    tables.write_reviews(prep.split_by_hash(views.reviews(spark, sf_dir), "review_id", seed=42), path)
    return tables.read_reviews(spark, path, lang="en", split="train").select("review_id", "stars", "product_category")


@report("s02_category_files")
def category_files(spark, sf_dir):
    """One folder of files a product category, read as one family; rows per category."""
    from minpair.sources import tables
    path = _place(spark, "categories")
    r = views.reviews(spark, sf_dir).select("review_id", "stars", "product_category")
    r.withColumn("category", F.col("product_category")).write.partitionBy("category").parquet(path)
    schema = T.StructType([T.StructField("review_id", T.LongType()), T.StructField("stars", T.IntegerType()),
                           T.StructField("product_category", T.StringType())])
    return tables.read_category_files(spark, [path], schema).groupBy("product_category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("stars").alias("stars"))


@report("s08_label_files_by_suffix")
def label_files_by_suffix(spark, sf_dir):
    """S10 + S08 + S06: label rows (ending ``lab``) and summaries (``csv``) of every run written into the same
    folders; each kind is chosen by its files' ending and read by header."""
    from minpair.sources import tables
    path = _place(spark, "runs")
    seed = T.StructField("seed", T.IntegerType())
    pairs = vote.seed_pairs(views.votes(spark, sf_dir))
    tables.write_result_csv(pairs.select(*tables.LABEL_SCHEMA.names, "seed"), path, partition_by=["seed"], mode="append", ending="lab")
    summ = bias.bias_stats(pairs, ["lang", "seed", "bias_type", "steps"]).select(*tables.SUMMARY_SCHEMA.names, "seed")
    tables.write_result_csv(rounded(summ), path, partition_by=["seed"], mode="append")
    labels = tables.read_result_csv(spark, path, T.StructType([*tables.LABEL_SCHEMA.fields, seed]), glob="*.lab")
    summaries = tables.read_result_csv(spark, path, T.StructType([*tables.SUMMARY_SCHEMA.fields, seed]), glob="*.csv")
    keys = ["seed", "steps", "lang", "bias_type"]
    n = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("label_1").alias("sum_1"), F.sum("label_2").alias("sum_2"))
    return n.join(summaries.select(*keys, "performance_gap"), keys, "full")


def write_run_folders(spark, root: str, configs: dict[str, tuple[str, str, list[str]]], steps: list[int]) -> None:
    """Stand-in input of the registry: a configuration text a name, and a file in a folder for every step of
    every run."""
    for name, (model_lang, test_lang, runs) in configs.items():
        text = "\n".join([f"model_lang: {model_lang}", f"test_lang: {test_lang}", "model_dirs:", *[f"  - {root}/models/{r}/" for r in runs], ""])
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/config/{name}")
        files = [(r, f) for r in runs for f in [*[f"checkpoint-{s}" for s in steps], "runs"]]
        rows = spark.createDataFrame([(r, f, "weights") for r, f in files], "run string, folder string, value string")
        for r in runs:
            rows.where(F.col("run") == r).select("folder", "value").write.partitionBy("folder").text(f"{root}/models/{r}")


@report("s09_registry_votes")
def registry_votes(spark, sf_dir):
    """The run registry, read from configuration texts and the folders of the runs that they name, says
    which votes belong to a run; rows and labels of each run."""
    from minpair.sources import tables
    root = _place(spark, "runs")
    dirs = [f"en_30.0_{s}_2021_11_28" for s, _ in dims.SEEDS]
    write_run_folders(spark, root, {"en": ("en", "en", dirs), "other": ("multi", "de", ["multi+en_5_7"])}, dims.STEPS)
    listed = tables.read_checkpoint_folders(spark, f"{root}/models").withColumn("name", F.regexp_replace("name", "^folder=", ""))
    runs = tables.run_registry(tables.read_run_configs(spark, f"{root}/config/*"), listed)
    runs = runs.where((F.col("test_lang") == "en") & (F.col("epochs") == 30)).select("run", "seed", "seed_rank", "steps")
    v = views.votes(spark, sf_dir).where(F.col("lang") == "en").drop("seed_rank")
    return v.join(runs, ["seed", "steps"]).groupBy("run", "seed_rank", "steps").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("label_sum"))


@report("s12_derived_files")
def derived_files(spark, sf_dir):
    """Performance figures written as CSV by step and read back."""
    from minpair.sources import tables
    path = _place(spark, "performance")
    p = perf.side_performance(_polarity(spark, sf_dir), ["bias_type", "steps"])
    cols = [f.name for f in tables.PERFORMANCE_SCHEMA.fields]
    tables.write_result_csv(rounded(p.select(*cols)), path, partition_by=["steps"])
    return rounded(tables.read_result_csv(spark, path, tables.PERFORMANCE_SCHEMA).drop("source_file"))


@report("s14_mart_family")
def mart_family(spark, sf_dir):
    """S14 + S07: the mart saved by model type and language, two model types of one language read
    back (F07, F08)."""
    from minpair.sources import tables
    path = _place(spark, "mart")
    tables.write_result_family(result_mart(spark, sf_dir), path)
    back = tables.read_result_family(spark, path)
    back = mart.keep_values(mart.keep_values(back, "model_type", ["mono", "multi_xl"]), "lang", ["de"])
    back = mart.keep_values(mart.keep_bias_type(back, "gender"), "emotion", ["joy", "fear"])
    return back.select("model_type", "emotion", "steps", "pair_id", "label_1", "label_2", "bias_direction")


@report("s15_mapping_file")
def mapping_file(spark, sf_dir):
    """S15 + J11: the category mapping written as the study's CSV, read back and applied; reviews per
    target category."""
    from minpair.sources import tables
    path = _place(spark, "mapping")
    m = category_mapping(spark)
    m.select("source_category", F.coalesce("target_category", F.lit("x")).alias("target_category"),
             F.when(F.col("uncertain"), F.lit("?")).otherwise(F.lit("")).alias("uncertain")).write.option(
        "header", "true").csv(path)
    r = prep.map_categories(views.reviews(spark, sf_dir).select("review_id", "product_category"),
                            tables.read_category_mapping(spark, path), "product_category")
    return r.groupBy("target_category", "uncertain").agg(F.count(F.lit(1)).alias("n"))


@report("s17_vote_log_file")
def vote_log_file(spark, sf_dir):
    """S17 + T12 + A26: the vote log written as text lines, read back, parsed and counted."""
    from minpair.sources import tables
    path = _place(spark, "votelog")
    keys = ["lang", "steps", "bias_type", "emotion", "side", "pair_id"]
    vote.render_vote_log(vote.vote_items(views.votes(spark, sf_dir), keys)).write.text(path)
    return rounded(vote.vote_log_shares(vote.parse_vote_log(tables.read_log_lines(spark, path))))


@report("a08_disagreeing_items")
def disagreeing_items(spark, sf_dir):
    """The list of items that the runs disagree about."""
    keys = ["lang", "steps", "bias_type", "emotion", "side", "pair_id"]
    return vote.disagreement_items(vote.vote_items(views.votes(spark, sf_dir), keys)).select(
        "lang", "steps", "side", "pair_id", "label", "kind")
