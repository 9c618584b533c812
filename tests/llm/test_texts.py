"""Shared helpers: chunks of rows, words, the bounded sample of labelled ids, rejected rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from minpair.llm import texts


def test_chunks_hold_every_row_once():
    col = ["a" * 5, None, "b" * 30, "", "c" * 4, "d" * 4, "e" * 4]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(col)], names=["i", "text"])
    got = list(texts.chunks(iter([batch, batch.slice(0, 0)]), "text", 10))
    assert [i for b, _ in got for i in b.column("i").to_pylist()] == list(range(7))
    assert [t for _, ts in got for t in ts] == [t or "" for t in col]
    assert all(sum(map(len, ts)) <= 10 or len(ts) == 1 for _, ts in got)


def test_words_and_counts(spark):
    rows = [None, "", " \t\n\x0b\x0c\r ", "A\x1cb C", "é É x y", "one\ntwo  three"]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    got = [r.n for r in df.select(texts.word_count(F.col("text")).alias("n")).collect()]
    assert got == [len(texts.words(t)) for t in rows] == [0, 0, 0, 2, 2, 3]
    assert texts.words("ÀB") == ["Àb".encode()]


def test_sampled_labels(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"))
    rows = [(i, i % 4 == 0) for i in range(3000)] + [(5, True), (None, True), (7, None)]
    labels = spark.createDataFrame([(i, None if y is None else int(y)) for i, y in rows], "doc_id long, y int")
    ids, total, share = texts.sampled_labels(docs, labels, "doc_id", "y", {0: 100, 1: 10_000})
    got = ids.collect()
    assert total == {0: 1499, 1: 500} and share[1] == 1.0  # 5 has both labels
    assert sum(r._y == 1 for r in got) == 500 and 50 < sum(r._y == 0 for r in got) < 170
    none, total, _ = texts.sampled_labels(docs, labels.limit(0), "doc_id", "y", {1: 10})
    assert none.count() == 0 and total == {}


def test_without_removes_rows_alike_only(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, None), (2, None), (3, "c"), (3, "c")], "doc_id long, text string")
    gone = docs.where("text = 'a' or text is null or doc_id = 3").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"))
    assert [tuple(r) for r in texts.without(docs, gone, "doc_id", "text").collect()] == [(1, "b")]
    assert texts.without(docs, gone.limit(0), "doc_id", "text").count() == 7
