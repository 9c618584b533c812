"""Corpus pipeline: five stages from raw documents to token ids.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept. All
stages but the last return the columns of ``documents``. Between stages the rows are written as
Parquet to the shared folder and read again.

1. quality: texts whose perplexity under a model of trusted text is over their language's cutoff go.
2. toxicity: texts with a score of 0.3 or more go.
3. near-duplicates: one document of each SimHash group stays, the one with the smallest id.
4. mixing: sources are brought to their target weights; a row stands as often as it is taken.
5. encoding: the last stage returns ``doc_id``, ``lang``, ``source``, ``ids``, ``n_tokens``, and
   digests of the ids and of the text that they are decoded to.

Edge cases: the operators' docstrings say what null, empty, long and repeated texts give; an empty
table gives an empty table with the same columns; columns beside those of ``documents`` pass through
the first four stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from minpair.llm import bpe, mixing, quality, simhash, toxicity
from minpair.llm.queries import table, word_tokenizer
from minpair.session import shared_path

TOXIC = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.reject(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"), TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs.select("doc_id", "lang", "source", "text"), word_tokenizer(), ["doc_id", "lang", "source"], ids="ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The model-based stages can't be written in SQL; the tests compare run() with its stages one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for ``documents``."""
    docs = table(spark, sf_dir, "documents")
    place = shared_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        out = f"{place}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
