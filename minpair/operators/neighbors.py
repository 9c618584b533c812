"""Nearest words by cosine similarity.

Seeds and vocabulary meet in blocks: the seeds are dealt into blocks of about ``SEED_BLOCK``, the
vocabulary into parts, and every part of the vocabulary meets every block of seeds in one task, where
one matrix product gives all similarities and each seed keeps its local top ``k``. A window then ranks
the at most ``k`` (and ties) candidates a seed and part. Nothing passes through the driver, and the
plan is the same for any number of seeds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT_SCHEMA = "seed string, word string, similarity double"
SEED_BLOCK, PART = 2_000, 20_000


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(m, axis=1)
    norms[norms == 0] = np.inf  # zero vectors: similarity 0
    return m / norms[:, None]


def _local_topk(k: int):
    def run(seeds: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        if seeds.empty or words.empty:
            return pd.DataFrame({"seed": [], "word": [], "similarity": []})
        sims = _unit(seeds["seed_vector"]) @ _unit(words["vector"]).T
        kk = min(k, sims.shape[1])
        cut = -np.partition(-sims, kk - 1, axis=1)[:, kk - 1]
        i, j = np.nonzero(sims >= cut[:, None])  # ties at the cut stay
        return pd.DataFrame({"seed": seeds["seed"].to_numpy()[i], "word": words["word"].to_numpy()[j], "similarity": sims[i, j]})
    return run


def nearest_words(vectors: DataFrame, seeds: DataFrame, k: int = 20, lower: bool = True) -> DataFrame:
    """W02 + T09: top ``k`` vocabulary words per seed word: ``(seed, word, similarity, rank)``.

    ``vectors(word, vector array<float>)``; ``seeds(word)``. Seeds are looked up as they are written;
    ``lower`` only lower-cases the words of the result. Seeds without a vector are left out here and
    listed by :func:`missing_seeds`. The seed itself is among its own neighbours. Ties at rank ``k``
    are broken by the word as written.
    """
    seed_vecs = seeds.select(F.col("word").alias("seed")).distinct().join(
        vectors.select(F.col("word").alias("seed"), F.col("vector").alias("seed_vector")), "seed")
    blocks = max(1, -(-seeds.count() // SEED_BLOCK))
    parts = max(1, -(-vectors.count() // PART))
    left = seed_vecs.withColumn("__block", F.pmod(F.xxhash64("seed"), F.lit(blocks)).cast("int")).withColumn(
        "__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = vectors.select("word", "vector", F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int").alias("__part"),
                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"))
    keys = ["__block", "__part"]
    cand = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_local_topk(k), OUT_SCHEMA)
    w = Window.partitionBy("seed").orderBy(F.desc("similarity"), "word")
    ranked = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("word", F.lower("word")) if lower else ranked


def missing_seeds(vectors: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seed words with no vector, as they are written (anti join)."""
    return seeds.select("word").distinct().join(vectors.select("word"), "word", "left_anti")


def neighbour_set(neighbours: DataFrame) -> DataFrame:
    """The union of all neighbour sets (distinct words)."""
    return neighbours.select("word").distinct()
