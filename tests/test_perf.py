"""Classification report / confusion goldens from published logs (2 decimals)."""

import pytest
from pyspark.sql import functions as F

from minpair.operators import perf

MATRIX_5 = [[801, 88, 48, 48, 15], [376, 222, 203, 173, 26], [164, 152, 265, 364, 55],
            [43, 31, 87, 536, 303], [17, 5, 22, 144, 812]]
REPORT_5 = {"1": (0.57, 0.80, 0.67, 1000), "2": (0.45, 0.22, 0.30, 1000), "3": (0.42, 0.27, 0.33, 1000),
            "4": (0.42, 0.54, 0.47, 1000), "5": (0.67, 0.81, 0.73, 1000),
            "macro avg": (0.51, 0.53, 0.50, 5000), "weighted avg": (0.51, 0.53, 0.50, 5000)}

MATRIX_3 = [[337, 41, 12], [814, 263, 93], [37, 3, 0]]  # rows gold, order positive, negative, neutral
REPORT_3 = {"positive": (0.28, 0.86, 0.43, 390), "negative": (0.86, 0.22, 0.36, 1170),
            "neutral": (0.00, 0.00, 0.00, 40), "macro avg": (0.38, 0.36, 0.26, 1600),
            "weighted avg": (0.70, 0.38, 0.36, 1600)}


def _from_matrix(spark, matrix, labels):
    rows = [(labels[i], labels[j], n) for i, r in enumerate(matrix) for j, n in enumerate(r) if n]
    df = spark.createDataFrame(rows, "gold string, pred string, n int")
    return df.select("gold", "pred", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_"))


@pytest.mark.parametrize("matrix,labels,expected,acc", [
    (MATRIX_5, ["1", "2", "3", "4", "5"], REPORT_5, 0.53),
    (MATRIX_3, ["positive", "negative", "neutral"], REPORT_3, 0.38),
])
def test_report_goldens(spark, matrix, labels, expected, acc):
    df = _from_matrix(spark, matrix, labels)
    rep = {r["row"]: r for r in perf.classification_report(df, [], "gold", "pred", labels=labels).collect()}
    for row, (p, r, f, s) in expected.items():
        got = rep[row]
        assert round(got["precision"], 2) == p and round(got["recall"], 2) == r
        assert round(got["f1"], 2) == f and got["support"] == s
    assert round(rep["accuracy"]["f1"], 2) == acc


def test_confusion_roundtrip(spark):
    labels = ["1", "2", "3", "4", "5"]
    df = _from_matrix(spark, MATRIX_5, labels)
    cm = {(r["row_label"], r["col_label"]): r["n"] for r in perf.confusion_matrix(df, [], "gold", "pred", labels).collect()}
    for i, row in enumerate(MATRIX_5):
        for j, n in enumerate(row):
            assert cm[(labels[i], labels[j])] == n


def test_macro_union_of_classes(spark):
    # predicted-only class counts as a zero class in the macro average
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c")], "gold string, pred string")
    m = perf.classification_metrics(df, [], "gold", "pred").first()
    assert m["n_classes"] == 3
    assert m["precision"] == pytest.approx((1 / 1 + 0 + 1) / 3)
    assert m["recall"] == pytest.approx((0.5 + 0 + 1) / 3)
