"""Unit and property tests of single operators on hand-made inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from minpair.functions import labels as L
from minpair.functions.ranking import positions
from minpair.functions.text import scrub, scrub_count
from minpair.operators import dist, prep
from minpair.sources.tables import corpus_to_json, read_corpus_json


def test_bias_direction_golden(spark):
    df = spark.createDataFrame([(-0.5,), (0.5,), (-1.0,), (2.0,)], "g double")
    got = [r[0] for r in df.select(L.bias_direction(F.col("g"))).collect()]
    assert got == [None, None, "male_bias", "female_bias"]


def test_polarity_and_gold(spark):
    df = spark.createDataFrame([(1, "joy"), (3, "no_emotion"), (5, "fear"), (None, "other")], "l int, e string")
    r = df.select(L.polarity(F.col("l")), L.gold_from_emotion(F.col("e")),
                  L.polarity_to_int(L.polarity(F.col("l")))).collect()
    assert [tuple(x) for x in r] == [("negative", "positive", 0), ("neutral", "neutral", 1),
                                     ("positive", "negative", 2), (None, None, None)]


def test_not_significant_handles_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (0.5,), (0.01,), (None,)], "p double")
    got = [r[0] for r in df.select(L.not_significant(F.col("p"))).collect()]
    assert got == [False, True, False, False]
    sig = [r[0] for r in df.select(L.significant(F.col("p"))).collect()]
    assert sig == [0, 0, 1, 0]


def test_wasserstein_golden_and_symmetry(spark):
    rows = [("k", "a", 1), ("k", "a", 1), ("k", "b", 2), ("k", "b", 2)]
    df = spark.createDataFrame(rows, "k string, s string, v int")
    assert dist.wasserstein(df, ["k"], "s", "v", "a", "b").first()["wasserstein"] == pytest.approx(1.0)
    assert dist.wasserstein(df, ["k"], "s", "v", "b", "a").first()["wasserstein"] == pytest.approx(1.0)
    same = spark.createDataFrame([("k", "a", 3), ("k", "b", 3)], "k string, s string, v int")
    assert dist.wasserstein(same, ["k"], "s", "v", "a", "b").first()["wasserstein"] == 0.0


def test_scrub_words(spark):
    df = spark.createDataFrame([("He said his MRS and Mr. Man were with the manager; she-wolf ÉHe",)], "t string")
    r = df.select(scrub(F.col("t")).alias("s"), scrub_count(F.col("t")).alias("n")).first()
    assert r["s"] == "_ said _ _ and _. _ were with the manager; _-wolf ÉHe"
    assert r["n"] == 6


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 50)), min_size=1, max_size=60))
def test_positions_equal_row_number(spark, rows):
    from pyspark.sql import Window
    df = spark.createDataFrame(rows, "p string, k int")
    got = positions(df, ["p"], [F.col("k")], name="pos")
    exp = df.withColumn("pos", F.row_number().over(Window.partitionBy("p").orderBy("k")) - 1)
    # ties in k make row numbers ambiguous: compare the multiset of (p, k, pos) ranks per k
    g = sorted((r.p, r.k) for r in got.collect())
    assert g == sorted((r.p, r.k) for r in exp.collect())
    pos_sets = {}
    for r in got.collect():
        pos_sets.setdefault(r.p, []).append(r.pos)
    for p, ps in pos_sets.items():
        assert sorted(ps) == list(range(len(ps)))


def test_balance_equal_classes(spark):
    rows = [(i, 1 + (i % 3 if i < 90 else 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, label int")
    out = prep.balance_classes(df, "label", "id", seed=1)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert set(counts.values()) == {30}


def test_split_exact_disjoint_complete(spark):
    df = spark.createDataFrame([(i,) for i in range(301)], "id long")
    out = prep.split_exact(df, "id", seed=42)
    ids = [r["id"] for r in out.collect()]
    assert sorted(ids) == list(range(301))
    c = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert c["train"] == 301 - 16 and c["validation"] == 8 and c["test"] == 8


def test_corpus_json_roundtrip(spark, tmp_path):
    rows = [("de", "anger", "male", 0, "Er ist wütend."), ("de", "anger", "female", 0, "Sie ist wütend."),
            ("de", "anger", "male", 1, "Der Mann ist wütend."), ("de", "anger", "female", 1, "Die Frau ist wütend."),
            ("de", "joy", "male", 0, "Er ist froh."), ("de", "joy", "female", 0, "Sie ist froh.")]
    long = spark.createDataFrame(rows, "lang string, emotion string, grp string, pair_id long, sentence string")
    js = corpus_to_json(long).first()["value"]
    p = tmp_path / "corpus.json"
    p.write_text(js, encoding="utf-8")
    back = read_corpus_json(spark, str(p), "de")
    got = sorted((r.emotion, r.grp, r.pair_id, r.sentence) for r in back.collect())
    assert got == sorted((e, g, i, s) for _, e, g, i, s in rows)


def test_chinese_variant(spark):
    from minpair.operators.text import chinese_variant
    docs = spark.createDataFrame([(1, "这是简体"), (2, "這是繁體"), (3, "这這"), (4, "plain text"), (5, "中文")],
                                 "id int, t string")
    table = spark.createDataFrame([("这", "simplified"), ("简", "simplified"), ("体", "simplified"),
                                   ("這", "traditional"), ("繁", "traditional"), ("體", "traditional")],
                                  "char string, variant string")
    got = {r["id"]: r["zh_variant"] for r in chinese_variant(docs, "id", "t", table).collect()}
    assert got == {1: "simplified", 2: "traditional", 3: "mixed", 4: None, 5: "unknown"}


def test_keep_values_and_relabel(spark):
    from minpair.operators import mart
    df = spark.createDataFrame([("en_scrubbed", "anger", 1), ("de", "joy", 2)], "lang string, emotion string, steps int")
    assert mart.keep_values(df, "emotion", ["joy"]).count() == 1
    assert [r["lang"] for r in mart.relabel(df).collect()] == ["en_s", "de"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 10_000)), min_size=1, max_size=80, unique=True),
       st.integers(1, 12))
def test_first_n_matches_row_number(spark, rows, n):
    from pyspark.sql import Window
    from minpair.functions.ranking import first_n
    df = spark.createDataFrame(rows, "p string, k int")
    got = sorted((r.p, r.k, r.pos) for r in first_n(df, ["p"], [F.col("k")], n).collect())
    exp = df.withColumn("pos", F.row_number().over(Window.partitionBy("p").orderBy("k")) - 1).where(F.col("pos") < n)
    assert got == sorted((r.p, r.k, r.pos) for r in exp.collect())


def test_distribution_edge_slices(spark):
    """One-sided or single-value slices give NULLs, never an ANSI division error."""
    df = spark.createDataFrame([("k", "a", 1), ("k", "a", 2), ("j", "a", 3), ("j", "b", 3)], "k string, s string, v int")
    w = {r["k"]: r["wasserstein"] for r in dist.wasserstein(df, ["k"], "s", "v", "a", "b").collect()}
    assert w == {"k": None, "j": 0.0}
    one = spark.createDataFrame([("k", 2.0)], "k string, v double")
    assert dist.kde_density(one, ["k"], "v").count() == 0
    ci = dist.normal_ci(one, ["k"], "v").first()
    assert ci["n"] == 1 and ci["ci_low"] is None


def test_texts_by_language_counts_chinese_twice(spark):
    from minpair.operators.text import texts_by_language
    df = spark.createDataFrame([("train", "zh", "simplified"), ("train", "en", None), ("test", "zh", "mixed")],
                               "split string, detected_lang string, zh_variant string")
    got = {(r["split"], r["detected_lang"]): r["n"] for r in texts_by_language(df, ["split"], "zh_variant").collect()}
    assert got[("train", "zh")] == 1 and got[("train", "zh_cn")] == 1 and got[("test", "zh_tr")] == 1
    assert got[(None, None)] == 5


def test_union_of_legacy_label_layouts(spark):
    from minpair.operators import mart
    cur = spark.createDataFrame([(3, 4, -1, "male", "female", "gender", 1, "de")],
                                "label_1 int, label_2 int, performance_gap int, bias_cat_1 string, bias_cat_2 string, "
                                "bias_type string, steps int, lang string")
    old = spark.createDataFrame([(2, 2, 0, "male", "female", "gender", 1, "de")],
                                "label_1 int, label_2 int, performance_gap int, bias_cat_1_name string, "
                                "bias_cat_2_name string, bias_type string, steps int, lang string")
    violin = spark.createDataFrame([(5, "male", "gender", 1, "de")],
                                   "label int, bias_cat_name string, bias_type string, steps int, lang string")
    no_labels = spark.createDataFrame([(1, "male", "female", "gender", 1, "es")],
                                      "performance_gap int, bias_cat_1 string, bias_cat_2 string, bias_type string, "
                                      "steps int, lang string")
    u = mart.union_results([mart.harmonise_labels(d) for d in (cur, old, violin, no_labels)])
    key = lambda t: tuple((x is None, "" if x is None else x) for x in t)
    rows = sorted(((r.label_1, r.bias_cat_1, r.performance_gap, r.lang) for r in u.collect()), key=key)
    assert rows == sorted([(3, "male", -1, "de"), (2, "male", 0, "de"), (5, "male", None, "de"),
                           (None, "male", 1, "es")], key=key)


def test_positions_keep_null_partition(spark):
    from pyspark.sql import Window
    rows = [(None, i) for i in range(5)] + [("x", i) for i in range(3)]
    df = spark.createDataFrame(rows, "p string, k int")
    got = sorted((r.p or "", r.k, r.pos) for r in positions(df, ["p"], [F.col("k")]).collect())
    exp = df.withColumn("pos", F.row_number().over(Window.partitionBy("p").orderBy("k")) - 1)
    assert got == sorted((r.p or "", r.k, r.pos) for r in exp.collect())


def test_nearest_words_looks_seeds_up_as_written(spark):
    """``Polish`` and ``polish`` are two words; only the result is lower-cased."""
    from minpair.operators import neighbors
    vec = spark.createDataFrame([("Polish", [1.0, 0.0]), ("polish", [0.0, 1.0]), ("Warsaw", [0.9, 0.1]), ("shine", [0.1, 0.9])],
                                "word string, vector array<float>")
    seeds = spark.createDataFrame([("Polish",), ("polish",), ("none",)], "word string")
    got = {(r["seed"], r["rank"]): r["word"] for r in neighbors.nearest_words(vec, seeds, k=2).collect()}
    assert got == {("Polish", 1): "polish", ("Polish", 2): "warsaw", ("polish", 1): "polish", ("polish", 2): "shine"}
    assert [r[0] for r in neighbors.missing_seeds(vec, seeds).collect()] == ["none"]


def test_nested_performance_keeps_null_groups_apart(spark):
    """A row without a group counts in its own group and once in its total."""
    from minpair.operators import perf
    df = spark.createDataFrame([("g", "a", 1, 1), ("g", None, 1, 0), ("g", "a", None, 1), (None, "b", 0, 0)],
                               "bias_type string, grp string, gold int, pred int")
    got = {(r["level"], r["bias_type"], r["grp"]): r["support"] for r in
           perf.nested_performance(df, "gold", "pred", "bias_type", "grp").collect()}
    assert got == {("group", "g", "a"): 1, ("group", "g", None): 1, ("group", None, "b"): 1,
                   ("bias_type", "g", ""): 2, ("bias_type", None, ""): 1, ("all", "", ""): 3}


def test_mean_labels_level_with_null_emotion(spark):
    """A row without an emotion is no total."""
    from minpair.operators import bias
    df = spark.createDataFrame([("de", "m", "joy", 4), ("de", "m", None, 2)], "lang string, grp string, emotion string, label int")
    got = sorted((r["level"], r["emotion"] or "", r["n"]) for r in bias.mean_labels(df, ["lang"]).collect())
    assert got == [("emotion", "", 1), ("emotion", "joy", 1), ("grp", "", 2)]


def test_identify_language_returns_every_text(spark):
    """Texts without a trigram come back as ``und``."""
    from minpair.operators import text
    labelled = spark.createDataFrame([(1, "the cat and the hat", "en"), (2, "der hund und die katze", "de")], "id int, text string, lang string")
    prof = text.trigram_profiles(labelled, "text", "lang")
    df = spark.createDataFrame([(1, "the hat"), (2, "ab"), (3, ""), (4, None), (5, "die katze")], "id int, text string")
    got = {r["id"]: r["detected_lang"] for r in text.identify_language(df, "id", "text", prof).collect()}
    assert got == {1: "en", 2: "und", 3: "und", 4: "und", 5: "de"}


def test_table_sees_new_files(spark, tmp_path):
    from minpair.sources.tables import table
    path = str(tmp_path / "events.parquet")
    spark.range(5).write.parquet(path)
    assert table(spark, str(tmp_path), "events").count() == 5
    spark.range(7).write.mode("append").parquet(path)
    assert table(spark, str(tmp_path), "events").count() == 12


def test_large_profiles_and_vocabularies_give_the_same(spark, monkeypatch):
    from minpair.operators import ml, text
    rows = [(1, "the cat sat on the mat", "en", "x y"), (2, "el gato en la mesa", "es", ""), (2, "rare zebra here", "en", None),
            (None, "the cat and el gato", "en", "cat mat zebra"), (None, "unknown", None, "gato"), (3, None, "en", "the"), (4, "ab", "es", "of the")]
    df = spark.createDataFrame(rows, "id long, t string, lang string, u string")

    def results():
        prof = text.trigram_profiles(df, "t", "lang")
        vocab = ml.build_vocabulary(ml.term_counts(df, "id", "t")).select("term", "id")
        found = [text.identify_language(df.withColumn("id2", F.coalesce("id", F.lit(0))), "id", "t", prof, ["id2"]).select("id", "id2", "detected_lang", F.round("score", 6)),
                 ml.encode_pairs(df, "id", "t", "u", vocab, max_length=12),
                 ml.tfidf(df, "id", "t").withColumn("tfidf", F.round("tfidf", 9))]
        return [sorted(map(str, f.collect())) for f in found]

    want = results()
    for most in (0, 2, 5):
        monkeypatch.setattr(text, "MOST_SENT_GRAMS", most)
        monkeypatch.setattr(ml, "MOST_SENT_WORDS", most)
        monkeypatch.setattr(ml, "MOST_SENT_IDF", most)
        assert results() == want


def test_the_terms_of_most_rows_are_not_joined_by_shuffle(spark, monkeypatch):
    from minpair.operators import ml
    rows = spark.createDataFrame([(i, t) for i in range(30) for t in ("all", f"own{i}")], "id long, term string")
    table = rows.groupBy("term").agg(F.count("*").alias("df"))
    joined = ml._by_common_terms(rows, table, "df", 5)
    assert sorted(map(tuple, joined.select("id", "term", "df").collect())) == sorted([(i, "all", 30) for i in range(30)] + [(i, f"own{i}", 1) for i in range(30)])
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
