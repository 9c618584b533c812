"""Fixed catalogues as small DataFrames.

Each catalogue is a constant-size table (tens of rows), so broadcasting it is safe at any data scale;
joins against these replace the nested dictionaries of a single-process script.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the evaluated study's definitions.
# ---------------------------------------------------------------------------------------------

# Bias catalogue: language -> bias type -> (privileged group, minoritized group). Order matters:
# the privileged group is side 1, so a positive gap means side 1 was scored higher.
BIAS_CATALOGUE = [
    ("ja", "gender", "male", "female"),
    ("ja", "race", "race: privileged", "race: minoritized"),
    ("de", "gender", "male", "female"),
    ("de", "race", "race: privileged", "race: minoritized"),
    ("es", "gender", "male", "female"),
    ("es", "race", "race: privileged", "race: minoritized"),
    ("zh", "gender", "male", "female"),
    ("en", "gender", "male", "female"),
    ("en", "race", "race: privileged", "race: minoritized"),
]

# Group names of each bias type, independent of language (used when a language has no entry).
BIAS_GROUPS = {"gender": ("male", "female"), "race": ("race: privileged", "race: minoritized")}

# Emotion categories in sheet order, and the category of templates without an emotion slot.
EMOTION_CATEGORIES = ["anger", "joy", "sadness", "fear"]
NO_EMOTION = "no_emotion"

# Person cells with this value mean "no marker" and become empty.
NON_MARKED = "non-marked"

# Grammar names per language and role, in search order.
GRAMMAR_CATALOGUE = {
    "ja": {"people": ["subject", "object"], "emotions": ["active", "passive"]},
    "de": {"people": ["subject", "acc. object", "dat. object"], "emotions": ["situation", "state"]},
    "es": {"people": ["subject", "object"],
           "emotions": ["state_estoy", "state_tengo", "situation_female", "situation_male",
                        "situation_male_plural"]},
    "zh": {"people": ["subject", "object"], "emotions": ["situation", "state"]},
    "en": {"people": ["subject", "object"], "emotions": ["situation_a", "situation_an", "state"]},
}

# Grammar name -> placeholder written in templates.
GRAMMAR_PLACEHOLDER = {
    "situation": "<emotional situation word>",
    "state": "<emotion word>",
    "subject": "<person subject>",
    "object": "<person object>",
    "acc. object": "<person acc. object>",
    "dat. object": "<person dat. object>",
    "active": "<emotion word active>",
    "passive": "<emotion word passive>",
    "state_estoy": "<emotion word A>",
    "state_tengo": "<emotion word B>",
    "situation_male_plural": "<emotional situation word plural>",
    "situation_female": "<emotional situation word female>",
    "situation_male": "<emotional situation word male>",
    "situation_a": "<emotional situation word a>",
    "situation_an": "<emotional situation word an>",
    "male": "<person male>",
    "female": "<person female>",
}

# The grammar whose sentences carry a second, female form of the emotion word (agreement languages).
AGREEMENT_LANGS = ["es"]
AGREEMENT_GRAMMAR = "state_estoy"

# Convergence step per model type (and language for per-language kinds). The compressed Spanish
# model has no value and drops out of convergence joins.
CONVERGENCE = [
    ("mono", "de", 35720), ("mono", "es", 35720), ("mono", "ja", 42864), ("mono", "zh", 35720),
    ("mono", "en", 28576), ("mono", "en_scrubbed", 25000),
    ("multi_xl", None, 100644),
    ("multi_xl_b", None, 75000),
    ("multi_on_mono", "de", 81250), ("multi_on_mono", "en", 87500), ("multi_on_mono", "es", 93750),
    ("multi_on_mono", "ja", 93750), ("multi_on_mono", "zh", 93750),
    ("mono_c", "de", 52621), ("mono_c", "ja", 60436), ("mono_c", "zh", 43750),
    ("mono_c", "en", 44285), ("mono_c", "en_scrubbed", 17193),
    ("multi_xl_c", None, 78280),
    ("multi_xl_c_b", None, 33336),
]

# Display order of model types.
MODEL_TYPE_ORDER = ["baseline", "mono", "multi_on_mono", "mono_c", "multi_xl", "multi_xl_c",
                    "multi_xl_b", "multi_xl_c_b"]

# Significance level and the number of model types it is corrected for.
ALPHA = 0.05
N_MODEL_TYPES = 8

# Gendered English words replaced by scrubbing (the misspelt entry is part of the list).
SCRUB_WORDS = ["he", "she", "her", "his", "him", "hers", "himself", "herself", "mr", "mrs", "ms",
               "wife", "husband", "daugher", "son", "woman", "man", "girl", "boy", "sister",
               "brother", "mother", "father", "mom", "dad", "aunt", "uncle", "ma", "pa",
               "girlfriend", "boyfriend"]
# Words matched case-free in every letter; the rest only in the first letter.
SCRUB_FULLY_CASELESS = ["mr", "mrs", "ms"]

# Vote-log message prefixes, one per disagreement kind.
VOTE_LOG_MESSAGES = {
    "no_winner": "disagreement, all different votes, returning middle",
    "one_winner": "disagreement, only one vote has more, using it",
    "tie": "disagreement, two labels are tied, arbitrarily picking one, labels: ",
}

# ---------------------------------------------------------------------------------------------
# Test binding of the driver tables (seed registry and steps of the synthetic vote fact table).
# ---------------------------------------------------------------------------------------------
SEEDS = [(0, 0), (5, 1), (26, 2), (42, 3), (63, 4)]  # (seed, seed_rank = registry position)
STEPS = [33334, 50001]
EMOTION_OF_DOC = ["anger", "joy", "sadness", "fear", "no_emotion"]  # element doc_id % 5


def bias_sides(spark: SparkSession) -> DataFrame:
    """Long form of the catalogue: (lang, bias_type, grp, side)."""
    rows = []
    for lang, bt, c1, c2 in BIAS_CATALOGUE:
        rows += [(lang, bt, c1, 1), (lang, bt, c2, 2)]
    return spark.createDataFrame(rows, "lang string, bias_type string, grp string, side int")


def grammar_catalogue(spark: SparkSession) -> DataFrame:
    rows = []
    for lang, roles in GRAMMAR_CATALOGUE.items():
        for role, names in roles.items():
            for idx, name in enumerate(names):
                rows.append((lang, role, idx, name, GRAMMAR_PLACEHOLDER[name]))
    return spark.createDataFrame(
        rows, "lang string, role string, grammar_idx int, grammar string, placeholder string")


def convergence(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONVERGENCE, "model_type string, lang string, steps int")


def model_type_order(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(MODEL_TYPE_ORDER)), "type_order int, model_type string")
