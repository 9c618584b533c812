"""Student-t p-values against published goldens; t-test edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from minpair.functions.stats import lgamma_sql, with_t_p_value
from minpair.operators.bias import bias_stats, paired_ttest


@pytest.mark.parametrize("t,n,p", [
    (-7.587851373892139, 1600, 5.4912349313557426e-14),
    (35.261280760147734, 10880, 5.388606160474619e-258),
    (-0.5714788624671916, 1776, 0.5677474381869663),
    # t = 2 and 5 at large n: the normal tail plus the first terms of its 1/dof expansion
    *[(t, n, math.erfc(t / math.sqrt(2)) + 2 * math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * (
        (t ** 3 + t) / (4 * (n - 1)) + (3 * t ** 7 - 5 * t ** 5 - 3 * t ** 3 - 9 * t) / (-96 * (n - 1) ** 2) * -1))
      for t in (2.0, 5.0) for n in (10 ** 6, 10 ** 9, 10 ** 11, 10 ** 12)],
])
def test_p_goldens(spark, t, n, p):
    df = spark.createDataFrame([(t, n)], "t double, n long")
    got = with_t_p_value(df, "t", F.col("n") - 1, "p").first()["p"]
    assert got == pytest.approx(p, rel=1e-9)


@pytest.mark.parametrize("t", [0.01, 0.5, 2.0, 4.0, 8.0])
def test_p_has_no_step_between_the_methods(spark, t):
    """Just below and above the change of method the values differ by their own slope only."""
    df = spark.createDataFrame([(t, 9_999), (t, 10_000), (t, 10_001)], "t double, v long")
    lo, mid, hi = [r.p for r in with_t_p_value(df, "t", F.col("v"), "p").orderBy("v").collect()]
    assert mid == pytest.approx((lo + hi) / 2, rel=1e-10)


def test_lgamma(spark):
    xs = [0.5, 1.0, 2.5, 7.0, 123.25, 5000.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(F.expr(lgamma_sql("x"))).collect()]
    for x, g in zip(xs, got):
        assert g == pytest.approx(math.lgamma(x), abs=1e-9)


def test_zero_variance_cases(spark):
    rows = [("zero", 3, 3)] * 4 + [("one", 4, 3)] * 4
    df = spark.createDataFrame(rows, "k string, label_1 int, label_2 int")
    out = {r["k"]: r for r in paired_ttest(df, ["k"]).collect()}
    assert out["zero"]["t_statistic"] is None and out["zero"]["statistical_significance"] is None
    assert out["one"]["statistical_significance"] == 0.0


def test_gap_antisymmetry(spark):
    rows = [("a", i % 5 + 1, (i * 3) % 5 + 1, "m", "f") for i in range(50)]
    df = spark.createDataFrame(rows, "k string, label_1 int, label_2 int, bias_cat_1 string, bias_cat_2 string")
    swapped = df.select("k", F.col("label_2").alias("label_1"), F.col("label_1").alias("label_2"),
                        "bias_cat_1", "bias_cat_2")
    a = bias_stats(df, ["k"]).first()
    b = bias_stats(swapped, ["k"]).first()
    assert a["performance_gap"] == pytest.approx(-b["performance_gap"])
    assert a["t_statistic"] == pytest.approx(-b["t_statistic"])
    assert a["statistical_significance"] == pytest.approx(b["statistical_significance"])


def test_planted_gap_is_significant(spark):
    rows = [("a", 4 + (i % 2), 2 + (i % 3 == 0), "m", "f") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, label_1 int, label_2 int, bias_cat_1 string, bias_cat_2 string")
    r = bias_stats(df, ["k"]).first()
    assert r["performance_gap"] > 1.5 and r["statistical_significance"] < 1e-50
