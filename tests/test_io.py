"""Sources and sinks on temporary folders."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minpair.operators import corpus, ml
from minpair.functions import labels as L
from minpair.sources import tables
from minpair.sources.views import reviews

from conftest import SF_SMALL


def test_reviews_partitioned_roundtrip(spark, tmp_path):
    from minpair.operators import prep
    r = prep.split_by_hash(reviews(spark, SF_SMALL), "review_id")
    path = str(tmp_path / "reviews")
    tables.write_reviews(r, path)
    back = tables.read_reviews(spark, path, lang="en", split="train")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "language" in plan
    assert back.count() == r.where("language = 'en' AND split = 'train'").count()


def test_category_files_skip_missing(spark, tmp_path):
    schema = T.StructType([T.StructField("review_id", T.LongType()), T.StructField("stars", T.IntegerType())])
    for name, rows in (("Books", [(1, 5), (2, 4)]), ("Toys", [(3, 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    paths = [str(tmp_path / f"{n}.parquet") for n in ("Books", "Toys", "Music")]
    df = tables.read_category_files(spark, paths[:2], schema)
    assert df.count() == 3
    expected = spark.createDataFrame([("Books",), ("Toys",), ("Music",)], "source_file string")
    loaded = df.withColumn("source_file", F.regexp_replace(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), r"\.parquet$", ""))
    skipped = [r[0] for r in tables.skipped_categories(loaded, expected).collect()]
    assert skipped == ["Music"]


def test_run_registry(spark):
    cfg = spark.createDataFrame([("de", "de", ["/m/de_30_42/", "/m/de_30_5"])],
                                "model_lang string, test_lang string, model_dirs array<string>")
    ck = spark.createDataFrame([("/m/de_30_42/", "checkpoint-100"), ("/m/de_30_42/", "checkpoint-9"),
                                ("/m/de_30_5", "checkpoint-100"), ("/m/de_30_5", "runs")], "model_dir string, name string")
    reg = sorted(tuple(r) for r in tables.run_registry(cfg, ck).select("run", "seed", "seed_rank", "steps").collect())
    assert reg == [("de_30_42", 42, 0, 9), ("de_30_42", 42, 0, 100), ("de_30_5", 5, 1, 100)]


def test_category_mapping_csv(spark, tmp_path):
    p = tmp_path / "map.csv"
    p.write_text("us_product_cat,marc_product_cat,uncertain?\nBooks_v1_00,book,\nGift_Card_v1_00,x,\nToys_v1_00,toy,?\n")
    m = {r[0]: (r[1], r[2]) for r in tables.read_category_mapping(spark, str(p)).collect()}
    assert m == {"Books_v1_00": ("book", False), "Gift_Card_v1_00": (None, False), "Toys_v1_00": ("toy", True)}


def test_result_family_partition_pruning(spark, tmp_path):
    df = spark.createDataFrame([("mono", "de", 1.0), ("multi_xl", "de", 2.0), ("mono", "en", 3.0)],
                               "model_type string, lang string, performance_gap double")
    root = str(tmp_path / "family")
    tables.write_result_family(df, root)
    back = tables.read_result_family(spark, root).where("lang = 'de'")
    assert sorted(r["performance_gap"] for r in back.collect()) == [1.0, 2.0]


def test_people_header_check(spark):
    from minpair.plans import corpus_parts
    corpus.check_people_header(corpus_parts.people(spark, SF_SMALL))
    bad = spark.createDataFrame([("a", "b")], "person_2 string, person_1 string")
    try:
        corpus.check_people_header(bad)
        raise AssertionError("expected a header error")
    except ValueError:
        pass


def test_label_helpers(spark):
    df = spark.createDataFrame([("3", [0.1, 0.7, 0.7], "multi", "de")], "s string, sc array<double>, m string, t string")
    r = df.select(L.stars_to_class(F.col("s")), L.argmax(F.col("sc")), L.effective_lang(F.col("m"), F.col("t")),
                  L.relabel_lang(F.lit("en_scrubbed"))).first()
    assert tuple(r) == (2, 1, "de", "en_s")


def test_pandas_udf_scorer(spark):
    from pyspark.sql.functions import pandas_udf

    from collections.abc import Iterator

    @pandas_udf("int")
    def length_scorer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield (s.str.len() % 5 + 1).astype("int32")

    df = spark.createDataFrame([("abc",), ("abcdef",)], "text string")
    got = [r["label"] for r in ml.score_with_udf(df, "text", length_scorer).collect()]
    assert got == [4, 2]


def test_vectorise_tfidf(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["b", "c"],)], "tokens array<string>")
    out, _ = ml.vectorise(df, "tokens", use_idf=True)
    norms = [float(sum(x * x for x in r["features"].toArray())) for r in out.collect()]
    assert all(abs(n - 1.0) < 1e-9 for n in norms)
    long = ml.tfidf(spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc")], "id int, text string"), "id", "text")
    want = sorted(round(r["tfidf"], 9) for r in long.collect())
    assert sorted(round(float(x), 9) for r in out.collect() for x in r["features"].toArray() if x) == want


def test_vector_models_keep_every_term(spark):
    """More terms than Spark ML's default vocabulary holds."""
    n = 300_000
    df = spark.range(300).select(F.transform(F.sequence(F.col("id") * (n // 300), (F.col("id") + 1) * (n // 300) - 1),
                                             lambda i: F.concat(F.lit("t"), i.cast("string"))).alias("tokens"))
    assert len(ml.count_vectorizer(df, "tokens", "f").fit(df).vocabulary) == n
    try:
        ml.count_vectorizer(df, "tokens", "f", max_terms=10)
        raise AssertionError("expected an error")
    except ValueError:
        pass


def test_lexicon_scores_every_row(spark):
    """Equal rows stay apart; stars are the rounded mean of the matches."""
    df = spark.createDataFrame([("en", "so glad today")] * 2 + [("en", "glad but cross"), ("fr", "glad"), ("en", None)], "lang string, s string")
    lex = spark.createDataFrame([("en", "glad", 5), ("en", "cross", 1)], "lang string, word string, stars int")
    got = sorted((r["lang"], r["s"] or "", r["label"]) for r in ml.score_lexicon(df, "s", lex).collect())
    assert got == [("en", "", 3), ("en", "glad but cross", 3), ("en", "so glad today", 5), ("en", "so glad today", 5), ("fr", "glad", 3)]


def test_linear_model_learns_and_scores(spark):
    """A separable set is learnt from words or characters, counts or tf-idf."""
    rows = [(i, ["bad awful thing", "plain usual thing", "great lovely thing"][i % 3] + f" w{i % 7}", float(i % 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, text string, y double")
    for chars in (False, True):
        for use_idf in (False, True):
            model = ml.train_linear(df, "text", "y", max_iter=20, chars=chars, use_idf=use_idf)
            scored = ml.score_with_model(df, model, "label")
            assert scored.where("label = y").count() >= 85


def test_result_csv_by_header(spark, tmp_path):
    """Files of three layouts in one folder: columns by name, old names, missing ones NULL."""
    (tmp_path / "a.csv").write_text("label_1,label_2,performance_gap,bias_cat_1,bias_cat_2,bias_type,steps,lang,emotion\n5,4,1,m,f,gender,10,de,joy\n")
    (tmp_path / "b.csv").write_text("label,bias_cat_name,bias_type,steps,lang\n3,m,gender,20,en\n")
    (tmp_path / "c.csv").write_text("lang,steps,bias_cat_1_name,bias_cat_2_name,label_1,label_2\nfr,30,m,f,1,2\n")
    df = tables.read_result_csv(spark, str(tmp_path), tables.LABEL_SCHEMA, renames=tables.LEGACY_LABEL_COLUMNS)
    got = sorted((r["lang"], r["steps"], r["label_1"], r["label_2"], r["bias_cat_1"], r["bias_cat_2"]) for r in df.collect())
    assert got == [("de", 10, 5, 4, "m", "f"), ("en", 20, 3, None, "m", None), ("fr", 30, 1, 2, "m", "f")]


def test_checkpoint_folder_on_a_cluster_must_be_named(spark, monkeypatch):
    from minpair import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    try:
        session.ensure_checkpoint_dir(Session())
        raise AssertionError("expected an error")
    except ValueError as e:
        assert "spark.checkpoint.dir" in str(e)


def test_result_csv_glob_and_nan(spark, tmp_path):
    """Result files chosen by suffix, ``nan`` p-values read as NULL."""
    d = tmp_path / "results"
    d.mkdir()
    header = ("bias_cat_1_mean,bias_cat_2_mean,performance_gap,statistical_significance,bias_cat_1_name,"
              "bias_cat_2_name,bias_type,steps,lang\n")
    (d / "de_42_emotion.csv").write_text(header + "3.9,3.9,0.0,nan,male,female,gender,50001,de\n")
    (d / "de_42.csv").write_text(header + "3.8,3.7,0.1,0.39,male,female,gender,50001,de\n")
    df = tables.read_result_csv(spark, str(d), tables.SUMMARY_SCHEMA, glob="*emotion.csv")
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["statistical_significance"] is None
    assert rows[0]["source_file"].endswith("de_42_emotion.csv")


def test_account_of_categories(spark, tmp_path):
    root = str(tmp_path / "cats")
    df = spark.range(20).selectExpr("id AS review_id", "concat('c', id % 2) AS category")
    df.repartition(2).write.partitionBy("category").parquet(root)
    (tmp_path / "cats" / "category=c1" / "part-broken.parquet").write_bytes(b"PAR1 nothing")
    (tmp_path / "cats" / "category=bad").mkdir()
    (tmp_path / "cats" / "category=bad" / "x.parquet").write_text("no")
    expected = spark.createDataFrame([("c0",), ("c1",), ("bad",), ("gone",)], "category string")
    schema = T.StructType([T.StructField("review_id", T.LongType())])
    got = {r.category: (r.state, r.files_unread, r.n_rows) for r in tables.account_categories(spark, root, expected, schema).collect()}
    assert got == {"c0": ("read", 0, 10), "c1": ("partly", 1, 10), "bad": ("unread", 1, 0), "gone": ("missing", 0, 0)}


def test_registry_of_real_folders(spark, tmp_path):
    for run, step in (("de_15.0_42_2021_10_21", 100), ("de_15.0_42_2021_10_21", 9), ("de_15.0_5", 100), ("fr_1_1", 7)):
        d = tmp_path / "m" / run / f"checkpoint-{step}"
        d.mkdir(parents=True)
        (d / "weights").write_text("x")
    (tmp_path / "m" / "de_15.0_5" / "runs").mkdir()
    (tmp_path / "m" / "de_15.0_5" / "runs" / "log").write_text("x")
    (tmp_path / "cfg").mkdir()
    (tmp_path / "cfg" / "de.yaml").write_text(f"model_lang: de\ntest_lang: en\nmodel_dirs:\n  - {tmp_path}/m/de_15.0_5\n  - file:{tmp_path}/m/de_15.0_42_2021_10_21/\n")
    runs = tables.run_registry(tables.read_run_configs(spark, str(tmp_path / "cfg")), tables.read_checkpoint_folders(spark, str(tmp_path / "m")))
    got = sorted(tuple(r) for r in runs.select("run", "model_lang", "test_lang", "lang", "epochs", "seed", "seed_rank", "steps").collect())
    assert got == [("de_15.0_42_2021_10_21", "de", "en", "de", 15, 42, 1, 9), ("de_15.0_42_2021_10_21", "de", "en", "de", 15, 42, 1, 100),
                   ("de_15.0_5", "de", "en", "de", 15, 5, 0, 100)]


def test_sheets_report_bad_rows_and_headers(spark, tmp_path):
    for lang, text in (("en", "a,b,n\nx,y,1\nx,y,oops\n,,3\n"), ("de", "b,a,n\ny,x,2\n"), ("fr", '"a","b",n\n"q, r",s,4\n')):
        (tmp_path / "s" / f"lang={lang}").mkdir(parents=True)
        (tmp_path / "s" / f"lang={lang}" / "sheet.csv").write_text(text)
    schema = T.StructType.fromDDL("a string, b string, n int")
    rows = tables.read_sheet(spark, str(tmp_path / "s"), schema)
    assert sorted(((r.lang, r.a, r.n, r.rejected) for r in rows.collect()), key=str) == sorted([
        ("en", "x", 1, None), ("en", "x", None, "x,y,oops"), ("en", None, 3, None), ("fr", "q, r", 4, None)], key=str)
    heads = {r.lang: r.header_ok for r in tables.sheet_headers(spark, str(tmp_path / "s"), ["a", "b"]).collect()}
    assert heads == {"en": True, "fr": True, "de": False}
    assert tables.read_sheet(spark, str(tmp_path / "s" / "lang=de"), schema).collect() == []


def test_outputs_replace_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "out")
    a = spark.createDataFrame([(1, "x", 1.5), (2, "y, z", None)], "seed int, name string, v double")
    n = tables.write_outputs({"first": a, "second": a.where("seed = 2")}, path, ["seed"])
    assert n == {"first": 2, "second": 1}
    tables.write_outputs({"first": spark.createDataFrame([(1, "new", 2.5)], a.schema)}, path, ["seed"])
    schema = T.StructType.fromDDL("name string, v double, seed int")
    assert sorted(tuple(r) for r in tables.read_output(spark, path, "first", schema).collect()) == [("new", 2.5, 1), ("y, z", None, 2)]
    assert [tuple(r) for r in tables.read_output(spark, path, "second", schema).collect()] == [("y, z", None, 2)]
