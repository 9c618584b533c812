"""Distributions behind the study's figures.

Every operator first aggregates to ``(slice, value, count)``: kernels and bootstrap replicates run over
distinct values, which are few for labels and gaps (``bin_width`` bounds those of continuous inputs).
Ranks and distribution functions are prefix sums over range partitions, so distinct values may be many.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minpair.functions.ranking import attach, cumulative
from minpair.session import materialise


def stack_columns(df: DataFrame, keys: list[str], cols: list[str], name: str = "value",
                  tag: str = "source") -> DataFrame:
    """Several columns into one (``stack``), tagged by the column they came from."""
    arr = F.array(*[F.struct(F.lit(c).alias(tag), F.col(c).alias(name)) for c in cols])
    return df.select(*keys, F.explode(arr).alias("_s")).select(*keys, f"_s.{tag}", f"_s.{name}")


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count and share of each value per slice."""
    c = value_counts(df, keys, value)
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def wasserstein(df: DataFrame, keys: list[str], sample: str, value: str, a, b) -> DataFrame:
    """1-D Wasserstein distance between samples ``a`` and ``b`` of ``value`` per slice.

    ``integral |F_a - F_b|`` over the union of observed values. Both distribution functions are prefix
    sums over range partitions, so a slice of continuous values spreads over many tasks.
    """
    c = df.groupBy(*keys, value).agg(
        F.sum(F.when(F.col(sample) == a, 1).otherwise(0)).alias("na"),
        F.sum(F.when(F.col(sample) == b, 1).otherwise(0)).alias("nb"))
    c = cumulative(c, keys, value, ["na", "nb"])
    fa, fb = (F.try_divide(F.col(f"{n}_before") + F.col(n), F.col(f"{n}_total")) for n in ("na", "nb"))
    width = (F.col("next_value") - F.col(value)).cast("double")
    g = c.groupBy(*keys).agg(F.coalesce(F.sum(F.abs(fa - fb) * width), F.lit(0.0)).alias("d"),
                             F.max("na_total").alias("ta"), F.max("nb_total").alias("tb"))
    # a slice where one sample is empty has no distance (NULL), rather than an ANSI division error
    return g.select(*keys, F.when((F.col("ta") > 0) & (F.col("tb") > 0), F.col("d")).alias("wasserstein"))


def five_numbers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles (linear interpolation) and Tukey whiskers (extreme values within 1.5 IQR).

    Ranks of the distinct values are prefix sums over range partitions, so a slice of continuous values
    spreads over many tasks; the two values next to each quartile are picked by their ranks, and the
    whiskers are found among all values once the fences are known.
    """
    v = F.col(value).cast("double")
    vc = df.where(v.isNotNull()).groupBy(*keys, v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    vc = materialise(cumulative(vc, keys, "v", ["c"]))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("c_before") <= rank) & (rank < F.col("c_before") + F.col("c")), F.col("v")))

    places = {q: p * (F.col("c_total") - 1) for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    near = vc.groupBy(*keys).agg(*[at(f(p)).alias(f"{q}_{n}") for q, p in places.items() for n, f in (("lo", F.floor), ("hi", F.ceil))],
                                 F.max("c_total").alias("c_total"))
    quartiles = near.select(*keys, *[(F.col(f"{q}_lo") + (p - F.floor(p)) * (F.col(f"{q}_hi") - F.col(f"{q}_lo"))).alias(q)
                                     for q, p in places.items()])
    vc = attach(vc, quartiles, keys)
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return vc.groupBy(*keys, "q1", "median", "q3").agg(
        F.sum("c").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.min(F.when(F.col("v") >= lo, F.col("v"))).alias("whisker_low"),
        F.max(F.when(F.col("v") <= hi, F.col("v"))).alias("whisker_high"))


def point_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Number of identical points per (slice, value) (bubble sizes)."""
    return value_counts(df, keys, value)


def min_max(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Global minimum and maximum of a column per slice (over a union of result sets)."""
    return df.groupBy(*keys).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def normal_ci(df: DataFrame, keys: list[str], value: str, z: float = 1.96) -> DataFrame:
    """A18 (closed form): mean with ``mean +- z * sd / sqrt(n)``."""
    v = F.col(value).cast("double")
    g = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    half = F.try_divide(z * F.col("sd"), F.sqrt(F.col("n").cast("double")))
    return g.select(*keys, "n", "mean", "sd", (F.col("mean") - half).alias("ci_low"),
                    (F.col("mean") + half).alias("ci_high"))


def _uniform(*cols: Column) -> Column:
    """Deterministic uniform in (0, 1): the first 52 bits of ``md5`` of the ``|``-joined values
    (the same draw in any engine that has md5)."""
    key = F.concat_ws("|", *[c.cast("string") for c in cols])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(16 ** 13)


#: What a count is split by, and how often the rejection is tried.
PART, TRIES = 16, 32


def _poisson_small(lam: Column, u: Column) -> Column:
    """Poisson(lam) draw by inversion, for ``lam`` below ``PART``."""
    k_max = (lam + 12.0 * F.sqrt(lam) + 12.0).cast("int")
    # state: (k, pmf, cdf, result)
    init = F.struct(F.lit(0).alias("k"), F.exp(-lam).alias("pmf"), F.exp(-lam).alias("cdf"),
                    F.lit(-1).alias("res"))

    def step(acc, _):
        found = (acc["res"] < 0) & (acc["cdf"] >= u)
        k1 = acc["k"] + 1
        pmf1 = acc["pmf"] * lam / k1
        return F.when(acc["res"] >= 0, acc).when(found, F.struct(
            acc["k"].alias("k"), acc["pmf"].alias("pmf"), acc["cdf"].alias("cdf"), acc["k"].alias("res"))
        ).otherwise(F.struct(k1.alias("k"), pmf1.alias("pmf"), (acc["cdf"] + pmf1).alias("cdf"),
                             F.lit(-1).alias("res")))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(k_max, F.lit(1))), init, step,
                       lambda acc: F.when(acc["res"] >= 0, acc["res"]).otherwise(acc["k"]))


def _log_factorial(k: Column) -> Column:
    """ln k! by Stirling's series at ``k + 9``, eight factors taken off."""
    z = k + 9.0
    product = k + 1.0
    for i in range(2, 9):
        product = product * (k + float(i))
    z2 = z * z
    series = (1.0 / 12.0 - (1.0 / 360.0 - (1.0 / 1260.0 - (1.0 / 1680.0) / z2) / z2) / z2) / z
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2.0 * math.pi) + series - F.log(product)


def _poisson_parts(lam: Column, uniform) -> Column:
    """Poisson(lam) draw for a positive multiple of ``PART`` by transformed rejection with squeeze (Hoermann's
    PTRS). ``uniform(tag, try)``: the two uniforms of a try. One try in four at most fails, so that after
    ``TRIES`` of them all have failed (then the mean is taken) less than once in 10**18 draws."""
    slam = F.sqrt(lam)
    b = 0.931 + 2.53 * slam
    a = -0.059 + 0.02483 * b
    vr = 0.9277 - 3.6224 / (b - 2.0)
    inv_alpha = 1.1239 + 1.1328 / (b - 3.4)

    def attempt(i: Column) -> Column:
        u, v = uniform("u", i) - 0.5, uniform("v", i)
        us = 0.5 - F.abs(u)
        k = F.floor((2.0 * a / us + b) * u + lam + 0.43).cast("double")
        quick = (us >= 0.07) & (v <= vr)
        full = ~((us < 0.013) & (v > us)) & (F.log(v) + F.log(inv_alpha) - F.log(a / (us * us) + b)
                                             <= k * F.log(lam) - lam - _log_factorial(k))
        return F.when((k >= 0) & (quick | full), k).otherwise(-1.0)

    found = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(-1.0), lambda acc, i: F.when(acc >= 0, acc).otherwise(attempt(i)))
    return F.when(found >= 0, found).otherwise(lam)


def poisson(count: Column, *key: Column) -> Column:
    """Poisson draw whose mean is a whole ``count``: the draw of the remainder of a division by ``PART`` plus
    the draw of the rest, both exact (a sum of Poisson draws is one), at any size. The uniforms are hashes of
    ``key``."""
    rest = F.pmod(count, F.lit(float(PART)))
    whole = count - rest
    small = _poisson_small(rest, _uniform(*key, F.lit(1)))
    return small + F.when(whole > 0, _poisson_parts(whole, lambda tag, i: _uniform(
        *key, F.concat(F.lit(tag), i.cast("string"))))).otherwise(0.0)


def bootstrap_ci(df: DataFrame, keys: list[str], value: str, replicates: int = 1000, seed: int = 0,
                 level: float = 0.95, bin_width: float | None = None) -> DataFrame:
    """A18 (bootstrap): Poisson bootstrap of the mean per slice.

    The data are first reduced to ``(slice, value, count)``; replicate ``b`` reweights each cell with
    an exact Poisson(count) draw seeded by ``md5(slice, value, b, seed)`` (the sum of ``count``
    independent Poisson(1) row weights). Work grows with slices x distinct values x replicates
    (``bin_width`` bounds the distinct values of continuous inputs).
    """
    v = _binned(F.col(value), bin_width)
    cells = df.where(v.isNotNull()).groupBy(*keys, v.alias("v")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    reps = cells.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b"))
    key_str = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("v").cast("string"))
    # the key is worked out once and not in every try
    reps = reps.withColumn("__key", F.concat_ws("|", key_str, F.col("b").cast("string"), F.lit(str(seed))))
    reps = reps.withColumn("w", poisson(F.col("c"), F.col("__key")).cast("double"))
    means = reps.groupBy(*keys, "b").agg(
        F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m"),
        (F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("point"), F.sum("c").alias("n"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    ci = means.groupBy(*keys).agg(F.first("n").cast("bigint").alias("n"), F.first("point").alias("mean"),
                                  F.percentile("m", [lo, hi]).alias("q"))
    return ci.select(*keys, "n", "mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def _binned(v: Column, bin_width: float | None) -> Column:
    """Values as doubles; with ``bin_width`` rounded to bin centres (continuous inputs), which bounds
    the distinct values per slice by range / width."""
    v = v.cast("double")
    return v if bin_width is None else F.round(v / bin_width) * bin_width


def kde_density(df: DataFrame, keys: list[str], value: str, grid_points: int = 64,
                cut: float = 3.0, bin_width: float | None = None) -> DataFrame:
    """Gaussian kernel density per slice on an even grid (violin outline).

    Bandwidth by Scott's rule ``sd * n^(-1/5)``; the grid spans ``[min - cut*bw, max + cut*bw]``.
    A slice's distinct values (bounded for labels and gaps; pass ``bin_width`` for continuous
    values) are gathered once; the grid is a generator and the kernel sum an ``aggregate`` over that
    small array - no join.
    """
    v = _binned(F.col(value), bin_width)
    cells = df.where(v.isNotNull()).groupBy(*keys, v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    st = cells.groupBy(*keys).agg(
        F.collect_list(F.struct("v", "c")).alias("vc"), F.sum("c").alias("n"),
        (F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("mean"),
        F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.sum(F.col("c") * F.col("v") * F.col("v")).alias("s2"))
    var = F.try_divide(F.col("s2") - F.col("n") * F.col("mean") * F.col("mean"), (F.col("n") - 1).cast("double"))
    st = st.withColumn("bw", F.sqrt(F.greatest(var, F.lit(0.0))) * F.pow(F.col("n").cast("double"), -0.2))
    st = st.where(F.col("bw") > 0)
    lo = F.col("vmin") - cut * F.col("bw")
    step = (F.col("vmax") - F.col("vmin") + 2 * cut * F.col("bw")) / (grid_points - 1)
    grid = st.select(*keys, "vc", "n", "bw", lo.alias("lo"), step.alias("step"),
                     F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("gi"))
    grid = grid.withColumn("x", F.col("lo") + F.col("gi") * F.col("step"))
    kern = F.aggregate("vc", F.lit(0.0), lambda acc, e: acc + e["c"] * F.exp(
        -0.5 * ((F.col("x") - e["v"]) / F.col("bw")) * ((F.col("x") - e["v"]) / F.col("bw"))))
    dens = kern / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))
    return grid.select(*keys, "gi", "x", dens.alias("density"))
