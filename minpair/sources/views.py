"""Derived views binding the driver tables to the study's data model.

All views are plain projections / generators over the driver tables (no joins unless stated), so
they scale with the tables and keep the scans prunable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minpair.plans import dims
from minpair.sources.tables import table


def emotion_of(doc_id: Column) -> Column:
    names = F.array(*[F.lit(e) for e in dims.EMOTION_OF_DOC])
    return F.element_at(names, (doc_id % len(dims.EMOTION_OF_DOC) + 1).cast("int"))


def bias_type_of(doc_id: Column) -> Column:
    """Gender and race in turn; every 41st document is of the retired type ``rank``."""
    return F.when(doc_id % 41 == 40, F.lit("rank")).when(doc_id % 2 == 0, F.lit("gender")).otherwise(F.lit("race"))


def group_name(bias_type: Column, side: Column) -> Column:
    expr = None
    for bt, (g1, g2) in dims.BIAS_GROUPS.items():
        val = F.when(side == 1, F.lit(g1)).otherwise(F.lit(g2))
        expr = F.when(bias_type == bt, val) if expr is None else expr.when(bias_type == bt, val)
    return expr.otherwise(F.concat(bias_type, F.lit("_"), side.cast("string")))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews view over ``documents``: five star classes from the text length."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("review_id"),
        F.col("text").alias("review_body"),
        F.concat_ws(" ", F.lit("Review"), "doc_id", F.lit("of her"), "source").alias("review_title"),
        F.col("lang").alias("language"),
        F.col("source").alias("product_category"),
        (F.lit(1) + F.col("n_chars") % 5).cast("int").alias("stars"),
    )


def votes(spark: SparkSession, sf_dir: str, seeds=None, steps=None) -> DataFrame:
    """Prediction fact table ``(lang, seed, seed_rank, steps, emotion, bias_type, grp, side,
    pair_id, label)``: every run labels both sides of every pair, but for one seed, which misses
    every 53rd document.

    The run x side product is a fixed literal array exploded per document (a generator, no join).
    """
    seeds = seeds or dims.SEEDS
    steps = steps or dims.STEPS
    # The run x side product as one literal array (SQL text: a single parse, not one call per value).
    combos = F.expr("array(" + ", ".join(
        f"named_struct('seed', {s}, 'seed_rank', {r}, 'steps', {st}, 'side', {side})"
        for (s, r) in seeds for st in steps for side in (1, 2)) + ")")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    x = d.select("doc_id", "lang", F.explode(combos).alias("r")).select("doc_id", "lang", "r.*")
    x = x.where(~((F.col("seed") == 42) & (F.col("doc_id") % 53 == 7)))
    label = F.lit(1) + ((F.col("doc_id") + 1) * (F.col("seed") + 3)
                        * (F.lit(7919) * F.col("side") + 13 + F.col("steps")) % 10007) % 5
    bt = bias_type_of(F.col("doc_id"))
    return x.select(
        "lang", "seed", "seed_rank", "steps",
        emotion_of(F.col("doc_id")).alias("emotion"),
        bt.alias("bias_type"),
        group_name(bt, F.col("side")).alias("grp"),
        "side",
        F.col("doc_id").alias("pair_id"),
        label.cast("int").alias("label"),
    )


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors ``(word, vector array<float>)`` from ``embeddings``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"),
                    F.col("embedding").alias("vector"), "vec_id", "label")
