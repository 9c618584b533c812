"""Plan-shape regression tests: the scale properties the operators are designed for."""

import re

import pytest

import __spark_entry__ as entry
from plan_summary import PATTERNS

from conftest import SF_SMALL

# report -> (max shuffles, must not contain)
EXPECTED = {
    "a04_ensemble_bias_by_emotion": (2, ["smj", "bnlj", "single_partition", "python", "sort_aggs"]),
    "a03_ensemble_bias": (2, ["smj", "bnlj", "single_partition", "python"]),
    "j06_ensemble_pairs": (1, ["smj", "bnlj", "single_partition"]),
    "a08_disagreements": (2, ["smj", "bnlj", "single_partition"]),
    "a13_confusion_matrix": (3, ["smj", "bnlj", "single_partition"]),
    # two of the shuffles only de-duplicate the convergence catalogue (tens of rows)
    "a29_mono_vs_multi": (5, ["smj", "bnlj", "single_partition"]),
    "s07_result_mart": (4, ["smj", "bnlj", "single_partition"]),
    "j04_converged_summaries": (5, ["smj", "bnlj", "single_partition"]),
    "m03_term_counts": (1, ["smj", "bnlj", "single_partition"]),
    "m04_tfidf": (4, ["smj", "bnlj", "single_partition"]),
    "w02_nearest_words": (6, ["smj", "bnlj", "single_partition"]),
    "m02_split": (0, ["smj", "bnlj", "single_partition", "windows"]),
}


def _plan(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_plan_shape(spark, name):
    max_shuffles, absent = EXPECTED[name]
    c = _plan(spark, name)
    assert c["shuffles"] <= max_shuffles, c
    for k in absent:
        assert c[k] == 0, (k, c)
