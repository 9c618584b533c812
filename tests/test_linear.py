"""The trained linear baseline: quality, a plain Python twin, and how often workers load it."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from minpair.operators import linear

WORDS = {"a": ["good", "great", "fine"], "b": ["bad", "awful", "poor"], "c": ["plain", "middling", "so"]}


def made(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        label = "abc"[i % 3]
        out.append((i, " ".join(rng.choice(WORDS[label]) if rng.random() < 0.5 else rng.choice(["the", "of", "it", "was"]) for _ in range(9)), label))
    return out


def twin(rows, rounds, reg):
    """Scores of every row by the same rounds in plain Python."""
    classes = sorted({r[2] for r in rows})
    xs = []
    for _, text, _ in rows:
        n = Counter(text.split())
        length = math.sqrt(sum(v * v for v in n.values()))
        xs.append({t: math.floor(1024 * v / length) for t, v in n.items()} | {"": 1024})
    w = [Counter() for _ in classes]
    for at in range(1, rounds + 1):
        for c, name in enumerate(classes):
            g = Counter()
            for (_, _, label), x in zip(rows, xs, strict=True):
                y = 1 if label == name else -1
                if y * sum(w[c][t] * v for t, v in x.items()) < 2 ** 40:
                    for t, v in x.items():
                        g[t] += y * v
            rate = 2 ** 30 / (1024 * reg * at * len(rows))
            w[c] = Counter({t: math.floor(w[c][t] * ((at - 1) / at) + g[t] * rate + 0.5) for t in set(w[c]) | set(g)})
    return [[sum(w[c][t] * v for t, v in x.items()) for c in range(len(classes))] for x in xs]


def test_rounds_equal_plain_python(spark):
    rows = made(40, 1)
    df = spark.createDataFrame(rows, "id long, text string, label string").repartition(7)
    model = linear.train(df, "id", "text", "label", rounds=4, reg=0.05)
    got = {r.id: list(r.p_scores) for r in linear.predict(df, "id", "text", model, "p").collect()}
    assert [got[i] for i in range(40)] == twin(rows, 4, 0.05)


@pytest.mark.parametrize(("chars", "use_idf"), [(False, False), (False, True), (True, True)])
def test_separable_texts_and_both_scorers(spark, chars, use_idf):
    schema = "id long, text string, label string"
    model = linear.train(spark.createDataFrame(made(90, 2), schema), "id", "text", "label", chars=chars, use_idf=use_idf)
    odd = [(900, None, None), (901, "", None), (902, "never seen words", None)]
    test = spark.createDataFrame(made(60, 3) + odd, schema)
    joined = {r.id: (r.label, r.p) for r in linear.predict(test, "id", "text", model, "p").collect()}
    if not chars:
        assert sum(a == b for a, b in joined.values()) >= 57
    labelled = test.withColumn("q", linear.scorer(model)(linear.tokens_of(F.col("text"), model))).collect()
    assert {r.id: r.q for r in labelled} == {i: p for i, (_, p) in joined.items()}


def test_null_labels_and_no_labels(spark):
    schema = "id long, text string, label int"
    df = spark.createDataFrame([(1, "up up", 1), (2, "down", 0), (3, "down up", None), (4, None, 1)], schema)
    model = linear.train(df, "id", "text", "label", rounds=3)
    assert model.classes == [0, 1] and {r.term for r in model.coefficients.collect()} == {"up", "down"}
    assert {r.id: r.p for r in linear.predict(df, "id", "text", model, "p").collect()}[1] == 1
    with pytest.raises(ValueError):
        linear.train(df.where("label is null"), "id", "text", "label")


def test_workers_load_the_model_once(spark):
    schema = "id long, text string, label int"
    rows = [(i, "good one" if i % 2 else "bad one", i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, schema)
    model = linear.train(df, "id", "text", "label", rounds=2)
    loads = spark.sparkContext.accumulator(0)
    scored = linear.score_corpus(df.repartition(40), "text", model, out="p", loads=loads)
    assert scored.where("p = label").count() == 400 and scored.where("p <> label").count() == 0
    # 80 tasks on four cores: workers are reused, so loads are bounded by workers, not by tasks.
    assert 1 <= loads.value <= 2 * (os.cpu_count() or 8)


def test_large_models_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "up", 1), (2, "down", 0)], "id long, text string, label int")
    model = linear.train(df, "id", "text", "label", rounds=1)
    monkeypatch.setattr(linear, "MOST_SENT_TERMS", 1)
    with pytest.raises(ValueError):
        linear.scorer(model)


@pytest.mark.parametrize(("use_idf", "most"), [(False, 2), (False, 3), (True, 0)])
def test_corpus_over_the_limit_is_scored_by_joins(spark, monkeypatch, use_idf, most):
    model = linear.train(spark.createDataFrame(made(60, 4), "id long, text string, label string"), "id", "text", "label", rounds=3, use_idf=use_idf)
    model.classes = [0, 1, 2]
    rows = [(i % 7, t) for i, t, _ in made(30, 5)] + [(None, None), (3, ""), (3, "never seen"), (3, "never seen"), (None, "good bad")]
    df = spark.createDataFrame(rows, "id long, text string")
    want = sorted((str(r.id), str(r.text), r.label) for r in linear.score_corpus(df, "text", model).collect())
    monkeypatch.setattr(linear, "MOST_SENT_TERMS", most)
    got = linear.score_corpus(df, "text", model)
    assert got.columns == ["id", "text", "label"]
    assert sorted((str(r.id), str(r.text), r.label) for r in got.collect()) == want


def test_corpus_gets_only_its_own_terms(spark, monkeypatch):
    model = linear.train(spark.createDataFrame(made(60, 4), "id long, text string, label string"), "id", "text", "label", rounds=2)
    model.classes = [0, 1, 2]
    df = spark.createDataFrame([(1, "good bad"), (2, "nothing known")], "id long, text string")
    want = [r.label for r in linear.score_corpus(df, "text", model).orderBy("id").collect()]
    monkeypatch.setattr(linear, "MOST_SENT_TERMS", 2)
    monkeypatch.setattr(linear, "predict", None)
    assert [r.label for r in linear.score_corpus(df, "text", model).orderBy("id").collect()] == want


@pytest.mark.parametrize("most", [0, 3])
def test_rounds_do_not_depend_on_which_terms_are_sent(spark, monkeypatch, most):
    rows = made(40, 1)
    df = spark.createDataFrame(rows, "id long, text string, label string")
    odd = df.unionByName(spark.createDataFrame([(None, "good of it", "a"), (7, "poor was", "b"), (7, "so so", "c"), (90, None, "a")], df.schema))
    whole = linear.train(odd, "id", "text", "label", rounds=4, reg=0.05)
    monkeypatch.setattr(linear, "MOST_COMMON", most)
    parts = linear.train(odd, "id", "text", "label", rounds=4, reg=0.05)
    assert sorted(map(tuple, parts.table().collect())) == sorted(map(tuple, whole.table().collect()))
    got = {r.id: list(r.p_scores) for r in linear.predict(df, "id", "text", linear.train(df, "id", "text", "label", rounds=4, reg=0.05), "p").collect()}
    assert [got[i] for i in range(40)] == twin(rows, 4, 0.05)


def test_parts_grow_with_the_texts(spark):
    from minpair.session import parts_of
    df = spark.createDataFrame([("x" * 900,), (None,)], "t string").crossJoin(spark.range(100))
    assert parts_of(df, "t") == 1
    assert parts_of(df.crossJoin(spark.range(200).select(F.col("id").alias("j"))), "t") == 2
