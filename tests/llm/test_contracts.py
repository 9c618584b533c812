"""Extra columns whose names operators use within, the bound of the rules by stratum, letters, many
languages, conversations without an id."""

import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from minpair.llm import chat, langid, lm, mixing, quality, rules, simhash, toxicity
from minpair.llm.queries import OP4_SQL

CLASHING = ["_id", "_t", "_x", "_h", "_text", "_train", "_root", "_lang", "_good", "_trusted", "_row", "_w", "_l", "_lines", "_upper", "_k",
            "mid", "top", "bits", "rare", "place", "cut", "whole", "p_source", "fp", "root", "least", "n", "kept", "size", "taken", "k_id", "a.b",
            "stratum", "_s", "c_symbol_share", "chunk", "trusted"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with an extra column of every such name, whose values tell its name and row."""
    rnd = random.Random(3)
    words = "the old house by the river stood empty for many years and nobody knew why".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(30)), "en", f"s{i % 3}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.withColumns({c: F.concat(F.lit(c + " "), F.col("doc_id").cast("string")) for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 4 == 0) for i in range(40)], "doc_id long, quality int, toxic boolean").withColumn(
        "toxic", F.col("toxic").cast("int"))


def passed(df, replaced=()):
    """All extra columns that the operator does not replace are there with their values."""
    rows = df.collect()
    assert rows
    names = [c for c in CLASHING if c not in replaced]
    for r in rows:
        got = r.asDict()
        assert [got[c] for c in names] == [f"{c} {r.doc_id}" for c in names]
    return rows


def test_extra_columns_pass_through_operators(clashing, labels):
    assert len(passed(mixing.mix(clashing), mixing.ADDED)) == 40
    assert len(passed(quality.score(clashing, labels), quality.ADDED)) == 40
    assert len(passed(lm.score(clashing, F.lit(True)), lm.ADDED)) == 40
    passed(simhash.near_duplicates(clashing), ("fp", "component_id"))
    measured = rules.measure(clashing)
    passed(measured)
    passed(rules.judge(measured, rules.cutoffs(measured, labels, "lang"), "lang"), ("kept", "c_symbol_share"))
    trees = langid.train(clashing)
    passed(langid.predict(clashing, trees))


def test_extra_columns_pass_through_filters(clashing, labels):
    """The pipeline's stages return every column as it was, in its place."""
    for out in (mixing.repeat(clashing), quality.reject(clashing, labels), simhash.keep_one(clashing),
                toxicity.reject(clashing, labels, 0.9)):
        assert out.columns == clashing.columns
        passed(out)


def test_rules_bound_holds_for_the_stratum(spark):
    """Each of two rules alone would reject 0.8 % of the good texts; together they keep the risk."""
    rows = [(i, " ".join(f"w{k}" if (i + k) % 2 else "Abc" for k in range(30)), "en") for i in range(2500)]
    rows += [(10_000 + i, " ".join("ABCDEF" for _ in range(2)) + " " + " ".join(f"XY{k}" for k in range(28)), "en") for i in range(20)]
    rows += [(20_000 + i, " ".join(f"w{k}!!!" for k in range(30)), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    measured = rules.measure(docs)
    judged = rules.judge(measured, rules.cutoffs(measured, good, "lang", risk=0.01), "lang").collect()
    assert sum(not r.kept and not r.base_failed for r in judged) <= 0.01 * len(rows)
    cuts = rules.cutoffs(measured, good, "lang", risk=0.2).collect()
    assert {r.n for r in cuts} == {len(rows)} and all(r.cutoff is not None for r in cuts)


def test_letters(spark):
    train = spark.createDataFrame([(1, "ab ba " * 50, "x")], "doc_id long, text string, lang string")
    texts = ["²", "½ ¼", "Ⅷ", "12 #", "é", "字", "a²", "ـ"]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), langid.train(train)).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == ["und"] * 4 + ["x"] * 4


def test_many_languages(spark):
    """More languages than any limit: each is learnt, and costs equal those of one table for all."""
    alphabet = [chr(0x4E00 + i) for i in range(600)]
    rows = [(i, (alphabet[2 * i] + alphabet[2 * i + 1] + " ") * 20, f"l{i:03d}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = langid.train(docs)
    assert trees.languages == [r[2] for r in rows]
    assert all(r.lang_pred == r.lang and r.score > 0.99 for r in langid.predict(docs, trees).collect())


def test_conversations_without_an_id(spark):
    """Each such row is a conversation of its own; pairs equal the SQL's."""
    rnd = random.Random(9)
    rows = [(rnd.choice([None, *range(-6, 14)]), rnd.randint(0, 3), rnd.choice(["user", "assistant", None]), rnd.choice(["x", "y", None, "z" * 5000]))
            for _ in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_pairs(chat.mismatched_pairs(table)).select("conv_id", "partner_id", "n_common", "prompt", "chosen_completion", "rejected_completion")
    conversations = table.toArrow()  # noqa: F841  (read by the SQL)
    want = duckdb.sql(f"SELECT conv_id, partner_id, n_common, prompt, chosen_completion, rejected_completion FROM ({OP4_SQL})").fetchall()
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert sum(r[0] is None for r in want) == sum(r[0] is None and r[2] == "assistant" for r in rows)
