"""Corpus inputs for the driver-table binding.

Templates and emotion words are small hand-written sheets (sentences written for this binding, in the
layout of the study's workbook); the people sheet is derived from the ``customer`` table, so the corpus grows
with the data. The sheets exercise the edge cases of the expansion: a grammar cell naming two
grammars, substring grammar matches (``situation_a`` inside ``situation_an``), a template without
an emotion slot, one without a person slot, agreement variants (es), ``non-marked`` people and
blank-padded names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minpair.plans import dims
from minpair.sources.tables import table

TEMPLATES = [
    ("en", 0, "<person subject> is <emotion word> again this evening."),
    ("en", 1, "Nobody expected <person object> to be so <emotion word>."),
    ("en", 2, "At breakfast we found <person object>  <emotion word>."),
    ("en", 3, "<person subject> wrote home about the <emotional situation word a> train ride."),
    ("en", 4, "<person subject> sat through an <emotional situation word an> rehearsal."),
    ("en", 5, "<person subject> repairs bicycles on Saturdays."),
    ("en", 6, "The baker waved at <person object> this morning."),
    ("en", 7, "The concert was <emotional situation word a> tonight."),
    ("en", 8, "<person subject> waters three plants."),
    ("en", 8, "<person subject> waters three plants."),
    ("es", 0, "Esta noche <person subject> está <emotion word A>."),
    ("es", 1, "Hoy <person subject> tiene <emotion word B>."),
    ("es", 2, "La reunión con <person object> fue <emotional situation word female>."),
    ("es", 3, "<person subject> toca la guitarra."),
]

EMOTIONS = [
    ("en", 0, "anger", "angry", "state", None),
    ("en", 1, "anger", "irritating", "situation_an", None),
    ("en", 2, "anger", "annoyed", "state", None),
    ("en", 3, "joy", "happy", "state", None),
    ("en", 4, "joy", "wonderful", "situation_a, state", None),
    ("en", 5, "joy", "amazing", "situation_an", None),
    ("en", 6, "sadness", "sad", "state", None),
    ("en", 7, "sadness", "depressing", "situation_a", None),
    ("en", 8, "fear", "scared", "state", None),
    ("en", 9, "fear", "horrible", "situation_a", None),
    ("en", 10, "fear", "annoyed", "state", None),
    ("en", 11, "anger, sadness", "upset", "state", None),
    ("es", 0, "anger", "enojado", "state_estoy", "enojada"),
    ("es", 1, "anger", "rabia", "state_tengo", None),
    ("es", 2, "joy", "contento", "state_estoy", "contenta"),
    ("es", 3, "joy", "maravillosa", "situation_female", None),
    ("es", 4, "sadness", "triste", "state_estoy", "triste"),
    ("es", 5, "sadness", "deprimente", "situation_female", None),
    ("es", 6, "fear", "miedo", "state_tengo", None),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "lang string, template_idx int, template string")


def emotions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        EMOTIONS, "lang string, emotion_idx int, emotion_category string, emotion_word string, grammar string, "
                  "emotion_word_female string")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person pairs: a customer and the customer with the next key in the same nation (equi-join).

    Even first keys make gender pairs, odd ones race pairs. Every 7th pair of the HOUSEHOLD segment
    has a ``non-marked`` second person (dropped later), names are blank-padded, and pairs whose
    first customer has a negative balance are usable in subject position only.
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    a = c.alias("a")
    b = c.select(F.col("c_custkey").alias("b_key"), F.col("c_name").alias("b_name"),
                 F.col("c_nationkey").alias("b_nation"))
    j = a.join(b, (F.col("b_key") == F.col("a.c_custkey") + 1) & (F.col("b_nation") == F.col("a.c_nationkey")))
    gender = F.col("a.c_custkey") % 2 == 0
    g1, g2 = dims.BIAS_GROUPS["gender"]
    r1, r2 = dims.BIAS_GROUPS["race"]
    non_marked = (F.col("a.c_mktsegment") == "HOUSEHOLD") & (F.col("a.c_custkey") % 7 == 0)
    langs = F.explode(F.array(F.lit("en"), F.lit("es")))
    return j.select(
        langs.alias("lang"),
        F.col("a.c_custkey").alias("person_idx"),
        F.concat(F.lit(" "), F.col("a.c_name")).alias("person_1"),
        F.when(non_marked, F.lit(dims.NON_MARKED)).otherwise(F.concat(F.col("b_name"), F.lit("  "))).alias("person_2"),
        F.when(gender, F.lit(g1)).otherwise(F.lit(r1)).alias("person_1_type"),
        F.when(gender, F.lit(g2)).otherwise(F.lit(r2)).alias("person_2_type"),
        F.when(gender, F.lit("gender")).otherwise(F.lit("race")).alias("bias_type"),
        F.when(F.col("a.c_acctbal") < 0, F.lit("subject")).otherwise(F.lit("subject, object")).alias("grammar"),
        F.when(gender, F.lit("male")).otherwise(F.lit("male")).alias("grammar_1"),
        F.when(gender, F.lit("female")).otherwise(F.lit("male")).alias("grammar_2"),
    )
