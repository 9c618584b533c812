"""Published example results: ensemble label pairs -> summary rows (means, gap, p).

The label-level file of the study's German ensemble run has 220 rows (2 bias types x 2 steps x 55
pairs). The paired statistics depend only on how often each (label_1, label_2) pair occurs, so the
input is given here as those counts; the expected rows are the published summary values.
"""

import pytest
from pyspark.sql import functions as F

from minpair.operators.bias import bias_stats

# Fixed values: (bias_type, steps, group 1, group 2) -> {(label_1, label_2): count}
PAIR_COUNTS = {
    ("gender", 33334, "male", "female"): {(2, 2): 3, (3, 3): 10, (4, 4): 23, (5, 4): 11, (5, 5): 8},
    ("gender", 50001, "male", "female"): {(1, 2): 1, (1, 3): 1, (2, 3): 1, (3, 2): 1, (3, 3): 11, (3, 4): 1,
                                          (4, 3): 2, (4, 4): 23, (4, 5): 2, (5, 3): 1, (5, 4): 6, (5, 5): 5},
    ("race", 33334, "race: privileged", "race: minoritized"): {(2, 2): 5, (2, 3): 6, (4, 3): 10, (4, 4): 32,
                                                               (4, 5): 2},
    ("race", 50001, "race: privileged", "race: minoritized"): {(3, 1): 1, (3, 2): 5, (3, 3): 13, (3, 4): 2,
                                                               (3, 5): 1, (4, 1): 1, (4, 2): 5, (4, 3): 1,
                                                               (4, 4): 21, (4, 5): 5},
}

# Published summary rows (mean 1, mean 2, gap, p) per (bias_type, steps).
EXPECTED = {
    ("gender", 50001): (3.8363636363636364, 3.7636363636363637, 0.07272727272727275, 0.3987159493479342),
    ("gender", 33334): (4.054545454545455, 3.8545454545454545, 0.20000000000000018, 0.0005491865107427672),
    ("race", 50001): (3.6, 3.381818181818182, 0.21818181818181825, 0.08981348122682112),
    ("race", 33334): (3.6, 3.5636363636363635, 0.0363636363636366, 0.6416354449154044),
}


def test_ensemble_summary_matches_published(spark):
    rows = [(bt, st, c1, c2, l1, l2, n) for (bt, st, c1, c2), cnt in PAIR_COUNTS.items()
            for (l1, l2), n in cnt.items()]
    df = spark.createDataFrame(rows, "bias_type string, steps int, bias_cat_1 string, bias_cat_2 string, "
                                     "label_1 int, label_2 int, n int")
    pairs = df.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_")).drop("n", "_")
    out = {(r["bias_type"], r["steps"]): r for r in bias_stats(pairs, ["bias_type", "steps"]).collect()}
    assert set(out) == set(EXPECTED)
    for key, (m1, m2, gap, p) in EXPECTED.items():
        r = out[key]
        assert r["n_pairs"] == 55
        assert r["bias_cat_1_mean"] == pytest.approx(m1, abs=1e-12)
        assert r["bias_cat_2_mean"] == pytest.approx(m2, abs=1e-12)
        assert r["performance_gap"] == pytest.approx(gap, abs=1e-12)
        assert r["statistical_significance"] == pytest.approx(p, rel=1e-9)


# Per-emotion pair counts of the same run, (bias_type, steps, emotion) -> counts.
EMOTION_PAIR_COUNTS = {
    ("gender", 33334, "anger"): {(2, 2): 2, (3, 3): 9},
    ("gender", 33334, "fear"): {(4, 4): 8, (5, 4): 3},
    ("gender", 33334, "joy"): {(2, 2): 1, (4, 4): 2, (5, 4): 4, (5, 5): 4},
    ("gender", 33334, "no_emotion"): {(4, 4): 4, (5, 4): 3, (5, 5): 4},
    ("gender", 33334, "sadness"): {(3, 3): 1, (4, 4): 9, (5, 4): 1},
    ("gender", 50001, "anger"): {(1, 2): 1, (1, 3): 1, (3, 3): 9},
    ("gender", 50001, "fear"): {(3, 3): 1, (3, 4): 1, (4, 4): 5, (5, 4): 3, (5, 5): 1},
    ("gender", 50001, "joy"): {(4, 3): 1, (4, 4): 6, (4, 5): 1, (5, 5): 3},
    ("gender", 50001, "no_emotion"): {(2, 3): 1, (3, 2): 1, (4, 3): 1, (4, 4): 2, (4, 5): 1, (5, 3): 1, (5, 4): 3,
                                      (5, 5): 1},
    ("gender", 50001, "sadness"): {(3, 3): 1, (4, 4): 10},
    ("race", 33334, "anger"): {(2, 2): 5, (2, 3): 6},
    ("race", 33334, "fear"): {(4, 3): 10, (4, 4): 1},
    ("race", 33334, "joy"): {(4, 4): 10, (4, 5): 1},
    ("race", 33334, "no_emotion"): {(4, 4): 11},
    ("race", 33334, "sadness"): {(4, 4): 10, (4, 5): 1},
    ("race", 50001, "anger"): {(3, 1): 1, (3, 2): 5, (3, 3): 4, (3, 4): 1},
    ("race", 50001, "fear"): {(3, 3): 9, (3, 4): 1, (3, 5): 1},
    ("race", 50001, "joy"): {(4, 4): 7, (4, 5): 4},
    ("race", 50001, "no_emotion"): {(4, 1): 1, (4, 2): 5, (4, 3): 1, (4, 4): 3, (4, 5): 1},
    ("race", 50001, "sadness"): {(4, 4): 11},
}

# Published per-emotion summary rows (mean 1, mean 2, gap, p; nan -> None).
EMOTION_EXPECTED = {
    ("gender", 50001, "anger"): (2.6363636363636362, 2.909090909090909, -0.27272727272727293, 0.19212703135616793),
    ("gender", 50001, "joy"): (4.2727272727272725, 4.2727272727272725, 0.0, 1.0),
    ("gender", 50001, "sadness"): (3.909090909090909, 3.909090909090909, 0.0, None),
    ("gender", 50001, "fear"): (4.181818181818182, 4.0, 0.18181818181818166, 0.34089313230206),
    ("gender", 50001, "no_emotion"): (4.181818181818182, 3.727272727272727, 0.4545454545454546, 0.13765791634772945),
    ("gender", 33334, "anger"): (2.8181818181818183, 2.8181818181818183, 0.0, None),
    ("gender", 33334, "joy"): (4.545454545454546, 4.181818181818182, 0.3636363636363642, 0.037928971445557756),
    ("gender", 33334, "sadness"): (4.0, 3.909090909090909, 0.09090909090909083, 0.34089313230206),
    ("gender", 33334, "fear"): (4.2727272727272725, 4.0, 0.2727272727272725, 0.08155339870160568),
    ("gender", 33334, "no_emotion"): (4.636363636363637, 4.363636363636363, 0.2727272727272734, 0.08155339870160568),
    ("race", 50001, "anger"): (3.0, 2.4545454545454546, 0.5454545454545454, 0.051942421407162306),
    ("race", 50001, "joy"): (4.0, 4.363636363636363, -0.3636363636363633, 0.037928971445557756),
    ("race", 50001, "sadness"): (4.0, 4.0, 0.0, None),
    ("race", 50001, "fear"): (3.0, 3.272727272727273, -0.27272727272727293, 0.19212703135616793),
    ("race", 50001, "no_emotion"): (4.0, 2.8181818181818183, 1.1818181818181817, 0.010607546331475976),
    ("race", 33334, "anger"): (2.0, 2.5454545454545454, -0.5454545454545454, 0.006080847927088538),
    ("race", 33334, "joy"): (4.0, 4.090909090909091, -0.09090909090909083, 0.34089313230206),
    ("race", 33334, "sadness"): (4.0, 4.090909090909091, -0.09090909090909083, 0.34089313230206),
    ("race", 33334, "fear"): (4.0, 3.090909090909091, 0.9090909090909092, 1.589553175596407e-06),
    ("race", 33334, "no_emotion"): (4.0, 4.0, 0.0, None),
}


def test_emotion_summary_matches_published(spark):
    rows = [(bt, st, e, l1, l2, n) for (bt, st, e), cnt in EMOTION_PAIR_COUNTS.items() for (l1, l2), n in cnt.items()]
    df = spark.createDataFrame(rows, "bias_type string, steps int, emotion string, label_1 int, label_2 int, n int")
    pairs = df.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_")).drop("n", "_")
    out = {(r["bias_type"], r["steps"], r["emotion"]): r
           for r in bias_stats(pairs, ["bias_type", "steps", "emotion"]).collect()}
    assert set(out) == set(EMOTION_EXPECTED)
    for key, (m1, m2, gap, p) in EMOTION_EXPECTED.items():
        r = out[key]
        assert r["bias_cat_1_mean"] == pytest.approx(m1, abs=1e-12)
        assert r["bias_cat_2_mean"] == pytest.approx(m2, abs=1e-12)
        assert r["performance_gap"] == pytest.approx(gap, abs=1e-12)
        if p is None:
            assert r["statistical_significance"] is None
        else:
            assert r["statistical_significance"] == pytest.approx(p, rel=1e-9)
