"""Bias statistics over aligned pairs: paired gap, group means, paired t-test.

Everything is one ``groupBy`` of partial-aggregatable functions (count, avg, stddev), so a hot slice
is pre-aggregated on the map side and the shuffle carries one small row per slice and partition.
The p-value is a native expression over the (few) aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minpair.functions.ranking import sent_if_few
from minpair.functions.stats import paired_t, with_t_p_value


def paired_ttest(df: DataFrame, keys: list[str], x: str = "label_1", y: str = "label_2") -> DataFrame:
    """``keys + n_pairs, mean_diff, sd_diff, t_statistic, statistical_significance``.

    Rows with a NULL on either side are ignored (pairwise complete cases).
    """
    diff = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(x) - F.col(y)).cast("double")
    g = df.groupBy(*keys).agg(
        F.count(diff).alias("n_pairs"),
        F.avg(diff).alias("mean_diff"),
        F.stddev_samp(diff).alias("sd_diff"),
    )
    t = paired_t(F.col("n_pairs"), F.col("mean_diff"), F.col("sd_diff"))
    g = g.withColumn("t_statistic", t)
    return with_t_p_value(g, "t_statistic", F.col("n_pairs") - 1)


def bias_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per slice the two group means, their gap, t and p.

    ``pairs`` carries ``label_1, label_2, bias_cat_1, bias_cat_2``; the group names are constant
    within a bias type and are carried as extra grouping keys.
    """
    name_keys = [k for k in ("bias_cat_1", "bias_cat_2") if k in pairs.columns and k not in keys]
    l1 = F.col("label_1").cast("double")
    l2 = F.col("label_2").cast("double")
    both = F.col("label_1").isNotNull() & F.col("label_2").isNotNull()
    diff = F.when(both, l1 - l2)
    g = pairs.groupBy(*keys, *name_keys).agg(
        F.count(diff).alias("n_pairs"),
        F.avg(F.when(both, l1)).alias("bias_cat_1_mean"),
        F.avg(F.when(both, l2)).alias("bias_cat_2_mean"),
        F.avg(diff).alias("mean_diff"),
        F.stddev_samp(diff).alias("sd_diff"),
    )
    t = paired_t(F.col("n_pairs"), F.col("mean_diff"), F.col("sd_diff"))
    out = g.select(
        *keys, *[F.col(k).alias(k + "_name") for k in name_keys],
        "n_pairs", "bias_cat_1_mean", "bias_cat_2_mean",
        (F.col("bias_cat_1_mean") - F.col("bias_cat_2_mean")).alias("performance_gap"),
        t.alias("t_statistic"), F.col("mean_diff"),
    )
    return with_t_p_value(out.drop("mean_diff"), "t_statistic", F.col("n_pairs") - 1)


def bias_stats_sets(pairs: DataFrame, base_keys: list[str], extra: str = "emotion") -> DataFrame:
    """A03 and A04 in one pass: ``groupingSets((base), (base, extra))``.

    The overall rows have ``extra`` NULL and ``level`` "all", the others ``level`` ``extra`` (which
    may be NULL in the data). The t statistic needs count, mean and sd only, all of which
    are grouping-set friendly.
    """
    l1 = F.col("label_1").cast("double")
    l2 = F.col("label_2").cast("double")
    diff = l1 - l2
    names = ["bias_cat_1", "bias_cat_2"]
    keys = base_keys + names
    g = pairs.groupingSets([keys, keys + [extra]], *keys, extra).agg(
        F.count(diff).alias("n_pairs"), F.avg(l1).alias("bias_cat_1_mean"),
        F.avg(l2).alias("bias_cat_2_mean"), F.stddev_samp(diff).alias("sd_diff"),
        F.avg(diff).alias("mean_diff"), F.grouping(extra).alias("__all"))
    t = paired_t(F.col("n_pairs"), F.col("mean_diff"), F.col("sd_diff"))
    level = F.when(F.col("__all") == 1, F.lit("all")).otherwise(F.lit(extra)).alias("level")
    out = g.select(*base_keys, extra, level, F.col("bias_cat_1").alias("bias_cat_1_name"),
                   F.col("bias_cat_2").alias("bias_cat_2_name"), "n_pairs", "bias_cat_1_mean",
                   "bias_cat_2_mean", (F.col("bias_cat_1_mean") - F.col("bias_cat_2_mean")).alias("performance_gap"),
                   t.alias("t_statistic"), "mean_diff")
    return with_t_p_value(out.drop("mean_diff"), "t_statistic", F.col("n_pairs") - 1)


def missing_groups(observed: DataFrame, catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """Catalogue groups absent from the observed ``(keys..., grp)`` rows (per slice,
    over the distinct observed values).

    ``catalogue`` is ``(lang, bias_type, grp, side)``; the result lists, for every observed slice,
    the expected groups that did not occur. A bias type with a missing group is skipped downstream.
    """
    slices = observed.select(*keys).distinct()
    # Slices x catalogue rows of their language: an equi-join on lang (catalogue is tiny).
    expected = slices.join(sent_if_few(catalogue), "lang")
    present = observed.select(*keys, "bias_type", "grp").distinct()
    return expected.join(present, [*keys, "bias_type", "grp"], "left_anti")


def attach_sides(predictions: DataFrame, sides: DataFrame) -> DataFrame:
    """Bias type and side of each prediction from the catalogue ``(lang, bias_type, grp,
    side)`` (broadcast equi-join on language and group; groups outside the catalogue drop out)."""
    return predictions.join(sent_if_few(sides), ["lang", "grp"])


def mean_labels(df: DataFrame, keys: list[str], group: str = "grp", extra: str = "emotion",
                label: str = "label") -> DataFrame:
    """Mean label per (keys, group) and per (keys, group, extra) in one grouping-set pass."""
    g = df.groupingSets([[*keys, group], [*keys, group, extra]], *keys, group, extra).agg(
        F.count(label).alias("n"), F.avg(F.col(label).cast("double")).alias("mean_label"), F.grouping(extra).alias("__all"))
    return g.withColumn("level", F.when(F.col("__all") == 1, F.lit(group)).otherwise(F.lit(extra))).drop("__all")
