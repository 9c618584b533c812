"""Result marts across model types and languages.

A family of result tables (one per model type and language) is one partitioned dataset; the
convergence catalogue is a broadcast dimension, so choosing the converged step is a join that prunes
rows (and, on partitioned storage, files), not a loop over file names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minpair.functions.ranking import sent_if_few
from minpair.functions.labels import (bias_direction, corrected_alpha, not_significant, relabel_lang,
                                      significant, within_band)
from minpair.operators.bias import paired_ttest
from minpair.plans import dims
from minpair.sources.tables import LEGACY_LABEL_COLUMNS


#: Rows up to which a catalogue is broadcast.
SMALL = 10_000


def union_results(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name; columns missing in a frame become NULL (older file layouts)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def harmonise_labels(df: DataFrame) -> DataFrame:
    """U01 input: rename older label-file columns to the current header (files without label
    columns simply lack them; :func:`union_results` fills NULLs)."""
    for old, new in LEGACY_LABEL_COLUMNS.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def tag(df: DataFrame, **constants) -> DataFrame:
    """Constant columns such as ``model_type`` or ``mono_multi``."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def convergence_filter(results: DataFrame, convergence: DataFrame, exempt: list[str] | None = None) -> DataFrame:
    """F03 + J04: keep each model type's rows at its convergence step.

    ``convergence(model_type, lang, steps)`` has ``lang`` NULL for language-independent kinds. Model
    types in ``exempt`` (the baseline) are kept whole; kinds without a catalogue entry drop out.
    Equi-joins only: one left join for the entries of a language, one for those of all languages.
    The catalogue (tens of rows) is broadcast after a look at its size, else joined by shuffle.
    """
    exempt = ["baseline"] if exempt is None else exempt
    few = convergence.limit(SMALL + 1).count() <= SMALL
    small = F.broadcast if few else (lambda df: df)
    named = convergence.where(F.col("lang").isNotNull()).select("model_type", "lang", "steps", F.lit(True).alias("__own")).distinct()
    shared = convergence.where(F.col("lang").isNull()).select("model_type", "steps", F.lit(True).alias("__all")).distinct()
    joined = results.join(small(named), ["model_type", "lang", "steps"], "left").join(small(shared), ["model_type", "steps"], "left")
    keep = F.coalesce("__own", "__all", F.col("model_type").isin(*exempt))
    return joined.where(keep).select(*results.columns)


def drop_bias_type(df: DataFrame, bias_type: str = "rank") -> DataFrame:
    """remove a retired bias type."""
    return df.where(F.col("bias_type") != bias_type)


def keep_bias_type(df: DataFrame, bias_type: str, substring: bool = False) -> DataFrame:
    """one bias type, by equality or (display scripts) substring - ``male`` also keeps
    ``female``."""
    c = F.col("bias_type")
    return df.where(c.contains(bias_type) if substring else c == bias_type)


def with_direction(df: DataFrame, gap: str = "performance_gap", negative: str = "male_bias",
                   positive: str = "female_bias") -> DataFrame:
    """P09 + P10: direction of the gap (truncated toward zero) and its absolute value."""
    return df.withColumns({"bias_direction": bias_direction(F.col(gap), negative, positive),
                           f"{gap}_abs": F.abs(F.col(gap))})


def significance_flags(summary: DataFrame, p: str = "statistical_significance", gap: str = "performance_gap",
                       alpha: float = dims.ALPHA, n_tests: int = dims.N_MODEL_TYPES, band: float = 0.1) -> DataFrame:
    """P11-P14 on summary rows: binary significance, not-significant mask, corrected threshold and
    the tolerance band."""
    return summary.withColumns({
        "significant": significant(F.col(p), alpha),
        "not_significant": not_significant(F.col(p), alpha),
        "significant_corrected": F.when(F.col(p).isNotNull() & ~F.isnan(p) & (F.col(p) < corrected_alpha(alpha, n_tests)),
                                        F.lit(1)).otherwise(F.lit(0)),
        "within_band": within_band(F.col(gap), band),
    })


def relabel(df: DataFrame, source: str = "en_scrubbed", target: str = "en_s") -> DataFrame:
    """P15."""
    return df.withColumn("lang", relabel_lang(F.col("lang"), source, target))


def with_type_order(df: DataFrame, order: DataFrame) -> DataFrame:
    """Attach the fixed display order of model types (broadcast dimension)."""
    return df.join(sent_if_few(order), "model_type", "left")


def paired_model_test(mart: DataFrame, type_a: str, type_b: str, keys: list[str], item_keys: list[str],
                      value: str = "performance_gap") -> DataFrame:
    """Paired t-test of ``value`` between two model types, items aligned by key.

    One shuffle: both model types' values of an item meet in one group (conditional aggregation)
    instead of a self-join of the mart; items missing either type are dropped.
    """
    m = mart.where(F.col("model_type").isin(type_a, type_b))
    pairs = m.groupBy(*keys, *item_keys).agg(
        F.max(F.when(F.col("model_type") == type_a, F.col(value))).alias("label_1"),
        F.max(F.when(F.col("model_type") == type_b, F.col(value))).alias("label_2"))
    return paired_ttest(pairs, keys)


def performance_curve(perf: DataFrame, keys: list[str]) -> DataFrame:
    """A31 + W04: f1 and accuracy by step (steps sorted numerically, not as text)."""
    return perf.select(*keys, "steps", "f1", "acc").orderBy(*keys, "steps")


def keep_values(df: DataFrame, col: str, values: list) -> DataFrame:
    """Keep one emotion, step, model type or language (or a list of them)."""
    return df.where(F.col(col).isin(*values))
