"""Positions and running sums by range parts; Poisson draws of any mean."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from minpair.functions import ranking
from minpair.operators import dist


@pytest.fixture
def many_parts(spark):
    """Parts stay as many as Spark makes them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def sparse(n, seed):
    """A hot partition, small ones and a NULL one; ids far apart."""
    rng = random.Random(seed)
    ids = rng.sample(range(10 ** 15), n)
    return [(rng.choice(["hot"] * 8 + ["a", "b", None]), i) for i in ids]


def test_positions_of_sparse_ids(many_parts):
    df = many_parts.createDataFrame(sparse(600, 1), "p string, k long")
    w = Window.partitionBy("p")
    want = df.withColumns({"pos": F.row_number().over(w.orderBy("k")) - 1, "n": F.count(F.lit(1)).over(w)}).collect()
    got = ranking.positions(df, ["p"], ["k"], total_name="n").collect()
    key = lambda r: (r.k, r.p or "", r.pos, r.n)
    assert sorted(map(key, got)) == sorted(map(key, want))
    down = ranking.positions(df, [], [F.desc("k")]).collect()
    assert [r.pos for r in sorted(down, key=lambda r: -r.k)] == list(range(600))
    rows = ranking.dealt(df, ["p", "k"])
    parts = rows.groupBy("__part", "p").count().collect()
    assert len(parts) <= 9 + 3 and max(r["count"] for r in parts) < 300  # the hot partition is split


def test_limits_by_partition(many_parts):
    df = many_parts.createDataFrame(sparse(300, 2), "p string, k long")
    limits = many_parts.createDataFrame([("hot", 70), ("a", 2), (None, 1)], "p string, __limit long")
    got = ranking.first_n(df, ["p"], ["k"], limits).groupBy("p").agg(F.count("*"), F.max("pos")).collect()
    assert {tuple(r) for r in got} == {("hot", 70, 69), ("a", 2, 1), (None, 1, 0)}
    assert ranking.positions(df.limit(0), ["p"], ["k"]).collect() == []


@pytest.mark.parametrize("keys", [["p"], []])
def test_cumulative(many_parts, keys):
    rng = random.Random(3)
    rows = sorted({(rng.choice(["hot"] * 8 + ["a", None]) if keys else "", rng.randrange(10 ** 6) / 7) for _ in range(500)}, key=str)
    cells = many_parts.createDataFrame([(p, v, rng.randrange(5)) for p, v in rows], "p string, v double, c long").select(*keys, "v", "c")
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    want = cells.select("*", F.coalesce(F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"),
                        F.sum("c").over(w).alias("t"), F.lead("v").over(w.orderBy("v")).alias("n")).collect()
    got = ranking.cumulative(cells, keys, "v", ["c"]).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, (tuple(r) for r in want)))


@pytest.mark.parametrize("mean", [1, 15, 16, 31, 100, 12345, 10 ** 9])
def test_poisson_draws(spark, mean):
    n = 4000
    draws = [r.w for r in spark.range(n).select(dist.poisson(F.lit(float(mean)), F.col("id")).alias("w")).collect()]
    assert all(w >= 0 and w == int(w) for w in draws)
    m = sum(draws) / n
    var = sum((w - m) ** 2 for w in draws) / (n - 1)
    assert abs(m - mean) < 5 * math.sqrt(mean / n)
    assert abs(var / mean - 1) < 5 * math.sqrt((2 + 1 / mean) / n)
    # The share of draws below the mean, which a rounded normal would miss for small means.
    below = sum(w < mean for w in draws) / n
    exact = sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(max(0, mean - 12 * math.isqrt(mean) - 12), mean)) \
        if mean < 10 ** 6 else 0.5
    assert abs(below - exact) < 0.04


def test_quartiles_of_continuous_values(many_parts):
    rng = random.Random(4)
    rows = [("a" if i % 5 else None, rng.gauss(0, 1)) for i in range(700)] + [("one", 3.0), ("gap", None)]
    df = many_parts.createDataFrame(rows, "p string, v double")
    got = {r.p: r for r in dist.five_numbers(df, ["p"], "v").collect()}
    for r in df.where("v is not null").groupBy("p").agg(F.percentile("v", [0.25, 0.5, 0.75]).alias("q"), F.count("v").alias("n")).collect():
        assert [got[r.p].q1, got[r.p].median, got[r.p].q3] == pytest.approx(r.q, abs=1e-12) and got[r.p].n == r.n
    assert set(got) == {"a", None, "one"} and got["one"].whisker_low == got["one"].whisker_high == 3.0
