"""Scalar label expressions (P02-P18) as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from minpair.plans import dims


def polarity(label: Column) -> Column:
    """Stars above 3 positive, below 3 negative, 3 neutral; NULL stays NULL."""
    return (F.when(label.isNull(), F.lit(None).cast("string"))
            .when(label > 3, F.lit("positive")).when(label < 3, F.lit("negative"))
            .otherwise(F.lit("neutral")))


def gold_from_emotion(emotion: Column) -> Column:
    """no_emotion neutral; anger, sadness, fear negative; joy positive; else NULL."""
    return (F.when(emotion == dims.NO_EMOTION, F.lit("neutral"))
            .when(emotion.isin("anger", "sadness", "fear"), F.lit("negative"))
            .when(emotion == "joy", F.lit("positive")))


def polarity_to_int(p: Column) -> Column:
    """Negative 0, neutral 1, positive 2."""
    return (F.when(p == "negative", F.lit(0)).when(p == "neutral", F.lit(1))
            .when(p == "positive", F.lit(2)))


def stars_to_class(stars: Column) -> Column:
    """Star text or number 1..5 to class id 0..4."""
    return stars.cast("int") - 1


def argmax(scores: Column) -> Column:
    """0-based index of the first maximum of an array of scores."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def bias_direction(gap: Column, negative: str = "male_bias", positive: str = "female_bias") -> Column:
    """Gap truncated toward zero; 0 -> NULL, < 0 -> ``negative``, > 0 -> ``positive``."""
    g = gap.cast("double").cast("bigint")
    return F.when(g < 0, F.lit(negative)).when(g > 0, F.lit(positive))


def significant(p: Column, alpha: float = dims.ALPHA) -> Column:
    """1 if p < alpha else 0 (NULL / NaN p give 0)."""
    return F.when(p.isNotNull() & ~F.isnan(p) & (p < alpha), F.lit(1)).otherwise(F.lit(0))


def not_significant(p: Column, alpha: float = dims.ALPHA) -> Column:
    """P > alpha, false for NULL and NaN (Spark orders NaN above every number)."""
    return p.isNotNull() & ~F.isnan(p) & (p > alpha)


def corrected_alpha(alpha: float = dims.ALPHA, n_tests: int = dims.N_MODEL_TYPES) -> Column:
    """Bonferroni threshold."""
    return F.lit(alpha / n_tests)


def within_band(gap: Column, band: float = 0.1) -> Column:
    """Gap within +-band."""
    return gap.between(-band, band)


def relabel_lang(lang: Column, source: str = "en_scrubbed", target: str = "en_s") -> Column:
    """Rename the scrubbed run's language."""
    return F.when(lang == source, F.lit(target)).otherwise(lang)


def effective_lang(model_lang: Column, target: Column) -> Column:
    """Data language is the target language when the model is multilingual."""
    return F.when(model_lang == "multi", target).otherwise(model_lang)
