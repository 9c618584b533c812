"""Quality rules with risk-controlled thresholds, in native expressions only.

Each rule measures one share of a text between 0 and 1 and rejects texts above a cutoff. Cutoffs are
chosen from labelled holdouts: for each stratum and rule the cutoffs of a fixed grid are tested from
the most lenient to the strictest, and the strictest one stands for which the exact binomial test
still shows, at the corrected level, that at most its part of ``risk`` of the good texts is rejected.
The rules of a stratum share ``risk`` evenly, so all of them together reject at most ``risk`` of its
good texts. Since the rejected sets are nested, the tests of one rule form a fixed sequence and need
no further share of the error; strata and rules share it evenly (Bonferroni). A rule without an
admissible cutoff rejects nothing in its stratum: with the defaults that is so in every stratum with
fewer than about 3,000 good labelled texts.

Edge cases: null and empty texts have no words, all shares are 0 and the base rejects them; null
strata form a stratum; labels that are null or contradict each other for an id are left out; an id
with several rows brings each of them; an empty table gives an empty table; no labels mean no cutoff;
input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minpair.llm.texts import SPACE_CLASS, fresh, private, shield
from minpair.session import materialise

WINDOW = 8
#: Cutoffs are multiples of 1/GRID.
GRID = 64
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(words: Column) -> Column:
    """A hash of each run of ``WINDOW`` words."""
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(
        F.size(h) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>")))


def _covered(windows: Column) -> Column:
    """Words in windows found twice or more: repeated windows in text order add the words that the
    one before has not covered."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        return F.filter(F.transform(s, lambda e, k: F.when(
            ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == e["h"]))
            | ((k < F.size(s) - 1) & (s[F.least(k + 1, F.size(s) - 1)]["h"] == e["h"])), e["i"])),
            lambda p: p.isNotNull())

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at"))
    count = F.aggregate(F.sort_array(_let(ordered, repeated)), zero, lambda a, p: F.struct(
        (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n"), p.alias("at")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), count).otherwise(F.lit(0).cast("long"))


def _found(text: Column, pattern: str) -> Column:
    return (F.size(F.split(text, pattern)) - 1).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All input columns but the text, with ``MEASURES``, ``RULES`` and ``base_failed``."""
    docs, back = shield(fresh(docs, *MEASURES, *RULES, "base_failed"), text)
    keep = [c for c in docs.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(*keep, t.alias("_t"), F.filter(F.split(t, SPACE_CLASS + "+"), lambda w: w != "").alias("_w"),
                      F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x09-\\x0D ]")).alias("_l"))
    counted = cut.select(
        *keep, F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _found(F.col("_t"), "[#*$%&|<>]").alias("n_symbols"),
        F.size("_l").alias("_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _let(_windows(F.col("_w")), _covered).alias("n_repeat_words"),
        _found(F.col("_t"), r"\p{Lu}").alias("_upper"), _found(F.col("_t"), "[!?]").alias("_marks"))

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.least(F.lit(1.0), F.col(part) / F.col(whole))).otherwise(0.0)

    return counted.select(
        *keep, *MEASURES, share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("_upper", "word_chars").alias("upper_share"), share("_marks", "n_words").alias("mark_share"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed")).withColumnsRenamed(back)


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series at n + 10 brought back to n; absolute error under 1e-10 of it."""
    x = n + 11.0
    series = ((x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5)
              - 1 / (1680 * x ** 7))
    back = F.log(n + 1.0)
    for i in range(2, 11):
        back = back + F.log(n + float(i))
    return series - back


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) and k under n p: the largest term, times the sum of the
    ratios of the terms below it, which fall off within a few standard deviations. For k at or
    over n p the tail is not needed and 1 is given."""
    k, n = k.cast("double"), n.cast("double")
    top = (_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
           + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    odds = (1 - p) / p
    steps = F.sequence(F.lit(0), F.least(k, F.ceil(12 * F.sqrt(n) + 50)).cast("int"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    total = F.aggregate(steps, start, lambda a, i: F.struct(
        (a["term"] * (k - i) / (n - k + i + 1) * odds).alias("term"), (a["sum"] + a["term"]).alias("sum")), lambda a: a["sum"])
    return F.when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, doc_id: str = "doc_id", label: str = "quality",
            risk: float = 0.01, level: float = 0.05) -> DataFrame:
    """``(stratum, rule, n, cutoff)`` for every stratum with good labelled texts; cutoff null where
    none is admissible. ``risk``: most good texts that all rules of a stratum together may reject;
    ``level``: chance that any cutoff of any stratum and rule breaks its part of that."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(
        F.min(label).alias("_lo"), F.max(label).alias("_hi")).where("_lo = _hi and _lo = 1").select(doc_id)
    good = measured.join(known, doc_id, "left_semi")
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.ceil(F.col(r) * GRID).cast("int").alias("bin"))
                                for r in RULES])).alias("x")
    hist = good.select(F.col(stratum).alias("stratum"), pairs).groupBy("stratum", "x.rule", "x.bin").agg(
        F.count("*").alias("c"))
    table = hist.groupBy("stratum", "rule").agg(F.collect_list(F.struct("bin", "c")).alias("bins"), F.sum("c").alias("n"))
    table = materialise(table)  # at most GRID + 1 bins a line
    strata = table.select("stratum").distinct().count()
    test = level / max(1, strata * len(RULES))
    # A text with ceil(share * GRID) = b is rejected by the cutoffs 0 .. b - 1.
    each = table.select("stratum", "rule", "n", "bins", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("b")).withColumn(
        "k", F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bin"] > F.col("b"), x["c"]).otherwise(0)))
    tested = each.withColumn("fine", binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)) <= test)
    return materialise(tested.groupBy("stratum", "rule").agg(
        F.max("n").alias("n"), (F.min(F.when(F.col("fine"), F.col("b"))) / GRID).alias("cutoff")))


def judge(measured: DataFrame, cuts: DataFrame, stratum: str) -> DataFrame:
    """``measured`` with the cutoffs and ``kept``: not failed by the base, and by no rule of its stratum."""
    measured = fresh(measured, "kept", *(f"c_{r}" for r in RULES))
    key, = private("stratum")
    wide = cuts.groupBy(F.col("stratum").alias(key)).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"c_{r}") for r in RULES])
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.col(f"c_{r}"), F.lit(False))
    return (measured.join(wide, F.col(stratum).eqNullSafe(F.col(key)), "left")
            .withColumn("kept", ~F.col("base_failed") & ~over).drop(key))
