"""Minimal-pair corpus construction.

The nested loops of a workbook script become equi-joins: each template is exploded into the grammar
names whose placeholder it contains, each vocabulary row into the grammar names its grammar cell
contains, and the two sides meet on ``(lang, grammar)``. The only large product is sentences x person
pairs, which is the corpus itself. De-duplication keeps the first pair in a total order by a
partial-aggregating ``min`` (hot duplicate groups are combined map-side), and pair ids are exact
positions computed without a single-task window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minpair.functions.ranking import positions, sent_if_few
from minpair.functions.text import collapse_whitespace
from minpair.plans import dims
from minpair.session import materialise

EMOTION_ORDER = dims.EMOTION_CATEGORIES + [dims.NO_EMOTION]


def _grammars(grammar_cat: DataFrame, role: str) -> DataFrame:
    return grammar_cat.where(F.col("role") == role).select("lang", "grammar_idx", "grammar", "placeholder")


def fill_emotions(templates: DataFrame, emotions: DataFrame, grammar_cat: DataFrame,
                  agreement_langs: list[str] | None = None) -> DataFrame:
    """J01 + U02 + F01 + F02: ``(lang, emotion, e_grammar_idx, template_idx, emotion_idx, text,
    variants)``.

    Templates with an emotion placeholder get one sentence per matching word (every occurrence of
    the placeholder replaced, literally); the rest form ``no_emotion`` (distinct template texts).
    In agreement languages the ``state_estoy`` sentences carry male / female variants.
    """
    agreement_langs = dims.AGREEMENT_LANGS if agreement_langs is None else agreement_langs
    eg = sent_if_few(_grammars(grammar_cat, "emotions"))  # fixed catalogue, a few rows
    # templates containing the grammar's placeholder.
    tg = templates.join(eg, "lang").where(F.col("template").contains(F.col("placeholder")))
    # words whose grammar / category cell contains the name (substring, NULL -> false).
    cats = F.explode(F.array(*[F.lit(c) for c in dims.EMOTION_CATEGORIES])).alias("emotion")
    em = emotions.withColumnRenamed("grammar", "grammar_cell")
    words = (em.join(eg.select("lang", "grammar"), "lang")
             .where(F.coalesce(F.col("grammar_cell"), F.lit("")).contains(F.col("grammar")))
             .select("*", cats)
             .where(F.coalesce(F.col("emotion_category"), F.lit("")).contains(F.col("emotion"))))
    j = tg.join(words.select("lang", "grammar", "emotion", "emotion_idx", "emotion_word", "emotion_word_female"),
                ["lang", "grammar"])
    text = F.replace(F.col("template"), F.col("placeholder"), F.col("emotion_word"))
    female = F.replace(F.col("template"), F.col("placeholder"), F.coalesce(F.col("emotion_word_female"),
                                                                           F.col("emotion_word")))
    agree = F.col("lang").isin(*agreement_langs) & (F.col("grammar") == dims.AGREEMENT_GRAMMAR) if agreement_langs \
        else F.lit(False)
    variants = F.when(agree, F.create_map(F.lit("male"), text, F.lit("female"), female))
    filled = j.select("lang", "emotion", F.col("grammar_idx").alias("e_grammar_idx"), "template_idx", "emotion_idx",
                      text.alias("text"), variants.alias("variants"))
    # Templates used by no emotion grammar, de-duplicated by text.
    used = tg.select("lang", "template").distinct()
    rest = (templates.join(used, ["lang", "template"], "left_anti")
            .groupBy("lang", "template").agg(F.min("template_idx").alias("template_idx")))
    none = rest.select("lang", F.lit(dims.NO_EMOTION).alias("emotion"), F.lit(-1).alias("e_grammar_idx"),
                       "template_idx", F.lit(-1).alias("emotion_idx"), F.col("template").alias("text"),
                       F.lit(None).cast("map<string,string>").alias("variants"))
    return filled.unionByName(none)


def clean_person(c: Column) -> Column:
    """``non-marked`` -> empty, then trim."""
    return F.trim(F.when(c == dims.NON_MARKED, F.lit("")).otherwise(c))


def emotion_rank(emotion: Column) -> Column:
    return F.array_position(F.array(*[F.lit(e) for e in EMOTION_ORDER]), emotion).cast("int")


def fill_people(sentences: DataFrame, people: DataFrame, grammar_cat: DataFrame,
                agreement_langs: list[str] | None = None) -> DataFrame:
    """J02 + J03 + F01 + F02 + F09 + T06 + T07: every sentence with a person placeholder x every pair
    of that grammar; both sides filled, whitespace collapsed. Not yet de-duplicated.
    """
    agreement_langs = dims.AGREEMENT_LANGS if agreement_langs is None else agreement_langs
    pg = sent_if_few(_grammars(grammar_cat, "people"))
    sg = sentences.join(pg, "lang").where(F.col("text").contains(F.col("placeholder")))
    pp = (people.withColumnRenamed("grammar", "grammar_cell").join(pg.select("lang", "grammar"), "lang")
          .where(F.coalesce(F.col("grammar_cell"), F.lit("")).contains(F.col("grammar"))))
    pp = pp.select("lang", "grammar", "person_idx", "bias_type",
                   clean_person(F.col("person_1")).alias("p1"), clean_person(F.col("person_2")).alias("p2"),
                   F.trim("person_1_type").alias("bias_cat_1"), F.trim("person_2_type").alias("bias_cat_2"),
                   F.trim("grammar_1").alias("g1"), F.trim("grammar_2").alias("g2"))
    pp = pp.where((F.col("p1") != "") & (F.col("p2") != ""))  # F09
    # The sentence side comes from the template and word sheets: few rows, as a rule, that are sent, so
    # that the person pairs (which grow with the data) aren't shuffled for this join.
    j = sent_if_few(sg).join(pp, ["lang", "grammar"])
    has_var = F.col("lang").isin(*agreement_langs) & F.col("variants").isNotNull() if agreement_langs else F.lit(False)
    base1 = F.when(has_var, F.coalesce(F.col("variants")[F.col("g1")], F.col("text"))).otherwise(F.col("text"))
    base2 = F.when(has_var, F.coalesce(F.col("variants")[F.col("g2")], F.col("text"))).otherwise(F.col("text"))
    s1 = collapse_whitespace(F.replace(base1, F.col("placeholder"), F.col("p1")))
    s2 = collapse_whitespace(F.replace(base2, F.col("placeholder"), F.col("p2")))
    return j.select("lang", "emotion", "bias_type", "bias_cat_1", "bias_cat_2",
                    F.col("grammar_idx").alias("p_grammar_idx"), emotion_rank(F.col("emotion")).alias("emotion_rank"),
                    "e_grammar_idx", "template_idx", "emotion_idx", "person_idx",
                    s1.alias("sentence_1"), s2.alias("sentence_2"))


ORDER = ["p_grammar_idx", "emotion_rank", "e_grammar_idx", "template_idx", "emotion_idx", "person_idx"]


def dedupe_pairs(candidates: DataFrame) -> DataFrame:
    """Keep the first occurrence of each (lang, sentence_1, sentence_2) in the total order.

    The key deliberately excludes emotion and bias type: a pair reached again under another emotion
    is dropped. ``min(struct(order..., payload...))`` combines duplicates map-side.
    """
    payload = ["emotion", "bias_type", "bias_cat_1", "bias_cat_2"]
    first = candidates.groupBy("lang", "sentence_1", "sentence_2").agg(
        F.min(F.struct(*ORDER, *payload)).alias("f"))
    return first.select("lang", "sentence_1", "sentence_2", *[F.col("f." + c).alias(c) for c in ORDER + payload])


def number_pairs(pairs: DataFrame) -> DataFrame:
    """Exact 0-based ``pair_id`` within (lang, emotion, bias_type) in corpus order."""
    return positions(pairs, ["lang", "emotion", "bias_type"], ORDER, name="pair_id")


def build_corpus(templates: DataFrame, emotions: DataFrame, people: DataFrame, grammar_cat: DataFrame,
                 agreement_langs: list[str] | None = None) -> DataFrame:
    """Entry 1 of the study: ``(lang, emotion, bias_type, pair_id, bias_cat_1, bias_cat_2,
    sentence_1, sentence_2)`` plus the order columns."""
    sents = fill_emotions(templates, emotions, grammar_cat, agreement_langs)
    cand = fill_people(sents, people, grammar_cat, agreement_langs)
    # Numbering reads the de-duplicated pairs twice (bucket counts, rows): materialise them once
    # in the shared checkpoint folder rather than re-running the expansion joins.
    return number_pairs(materialise(dedupe_pairs(cand)))


def corpus_long(pairs: DataFrame) -> DataFrame:
    """Long form ``(lang, emotion, bias_type, side, grp, pair_id, sentence)``."""
    sides = F.array(F.struct(F.lit(1).alias("side"), F.col("bias_cat_1").alias("grp"), F.col("sentence_1").alias("sentence")),
                    F.struct(F.lit(2).alias("side"), F.col("bias_cat_2").alias("grp"), F.col("sentence_2").alias("sentence")))
    return pairs.select("lang", "emotion", "bias_type", "pair_id", F.explode(sides).alias("s")).select(
        "lang", "emotion", "bias_type", "s.side", "s.grp", "pair_id", "s.sentence")


def validate_pairs(long: DataFrame) -> DataFrame:
    """(lang, emotion, bias_type) slices whose two sides differ in size (must be empty)."""
    g = long.groupBy("lang", "emotion", "bias_type").agg(
        F.count_if(F.col("side") == 1).alias("n_side_1"), F.count_if(F.col("side") == 2).alias("n_side_2"))
    return g.where(F.col("n_side_1") != F.col("n_side_2"))


def corpus_sizes(pairs: DataFrame) -> DataFrame:
    """Pairs, distinct pairs and distinct sentences per (lang, bias_type, emotion), with
    rollup totals (NULL emotion = all emotions of a bias type; NULL bias type = language total).

    A pair and its two sentences are one row each for their language, combined before the shuffle, with the
    set of slices that they occur in (a few, as types and emotions are catalogues); each then counts once in
    every slice and total that its set touches. The rows are never copied for the levels.
    """
    def thing(kind: str, a, b):
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))

    s1, s2, none = F.col("sentence_1"), F.col("sentence_2"), F.lit(None).cast("string")
    things = pairs.where(F.col("lang").isNotNull()).select("lang", "bias_type", "emotion", F.explode(F.array(
        thing("pair", s1, s2), thing("one", s1, none), thing("two", s2, none))).alias("t"))
    things = things.where(F.col("t.a").isNotNull() & ((F.col("t.kind") != "pair") | F.col("t.b").isNotNull()))
    slices = things.groupBy("lang", "t.kind", "t.a", "t.b").agg(
        F.collect_set(F.struct(F.lit(0).alias("level"), "bias_type", "emotion")).alias("own"))
    types = F.array_distinct(F.transform("own", lambda s: F.struct(
        F.lit(1).alias("level"), s["bias_type"].alias("bias_type"), none.alias("emotion"))))
    whole = F.array(F.struct(F.lit(3).alias("level"), none.alias("bias_type"), none.alias("emotion")))
    keys = ["lang", "level", "bias_type", "emotion"]
    distinct = slices.select("lang", "kind", F.explode(F.concat("own", types, whole)).alias("s")).select("lang", "kind", "s.*").groupBy(*keys).agg(
        F.count_if(F.col("kind") == "pair").alias("n_distinct_pairs"), F.count_if(F.col("kind") == "one").alias("n_distinct_side_1"),
        F.count_if(F.col("kind") == "two").alias("n_distinct_side_2"))
    n = pairs.rollup("lang", "bias_type", "emotion").agg(F.count(F.lit(1)).alias("n_pairs"), F.grouping_id().cast("int").alias("level"))
    same = distinct.select(*[F.col(k).alias(f"__{k}") for k in keys], "n_distinct_pairs", "n_distinct_side_1", "n_distinct_side_2")
    on = [n[k].eqNullSafe(same[f"__{k}"]) for k in keys]
    sizes = n.where(F.col("level") < 7).where(F.col("lang").isNotNull()).join(same, on, "left")
    return sizes.select("lang", "bias_type", "emotion", "n_pairs", *[F.coalesce(c, F.lit(0)).alias(c) for c in (
        "n_distinct_pairs", "n_distinct_side_1", "n_distinct_side_2")])


def first_sentences(pairs: DataFrame, n: int = 11) -> DataFrame:
    """The first ``n`` pairs of every (lang, emotion, bias type) - a filter on the dense id."""
    return pairs.where(F.col("pair_id") < n)


PEOPLE_HEADER = ["person_1", "person_2", "person_1_type", "person_2_type", "bias_type", "grammar"]


def check_people_header(people: DataFrame, expected: list[str] | None = None) -> None:
    """The first six people columns must come in the fixed order (raises otherwise)."""
    expected = expected or PEOPLE_HEADER
    cols = [c for c in people.columns if c not in ("lang", "person_idx")][:len(expected)]
    if cols != expected:
        raise ValueError(f"people columns out of order: expected {expected}, got {cols}")


def each_run(df: DataFrame, runs: list[tuple]) -> DataFrame:
    """The rows for every run of a fixed registry - a generator over the list, no join; ``runs``
    are ``(seed, seed_rank, steps)`` tuples. Scoring then joins each run's own model."""
    arr = F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(r).alias("seed_rank"), F.lit(st).alias("steps"))
                    for s, r, st in runs])
    return df.select("*", F.explode(arr).alias("__run")).select(*df.columns, "__run.*")
