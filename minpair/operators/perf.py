"""Performance statistics.

Every metric starts from the confusion counts ``groupBy(keys, gold, pred).count()``: a partial
aggregation whose output is bounded by slices x classes^2, so hot slices never reach one task as
raw rows. Per-class and macro metrics are computed from those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minpair.functions.labels import gold_from_emotion, polarity, polarity_to_int


def polarity_frame(pairs: DataFrame) -> DataFrame:
    """P08 + J09: polarity of both labels, gold from emotion, integer codes and the polarity gap.

    The star labels are kept (``label_1``/``label_2``) next to the polarity columns, so later
    metric steps can use either scale.
    """
    p1, p2 = polarity(F.col("label_1")), polarity(F.col("label_2"))
    gold = gold_from_emotion(F.col("emotion"))
    return pairs.withColumns({
        "polarity_1": p1, "polarity_2": p2, "gold_label": gold,
        "gold_label_int": polarity_to_int(gold),
        "polarity_1_int": polarity_to_int(p1), "polarity_2_int": polarity_to_int(p2),
    }).withColumn("polarity_gap", F.col("polarity_1_int") - F.col("polarity_2_int"))


def sides_long(df: DataFrame, keys: list[str], value_1: str, value_2: str, cat_1: str = "bias_cat_1",
               cat_2: str = "bias_cat_2", extra: list[str] | None = None) -> DataFrame:
    """Unpivot the two sides into rows ``keys + extra + (side, bias_cat, pred)`` (U06 shape)."""
    extra = extra or []
    sides = F.array(
        F.struct(F.lit(1).alias("side"), F.col(cat_1).alias("bias_cat"), F.col(value_1).alias("pred")),
        F.struct(F.lit(2).alias("side"), F.col(cat_2).alias("bias_cat"), F.col(value_2).alias("pred")))
    return df.select(*keys, *extra, F.explode(sides).alias("s")).select(*keys, *extra, "s.*")


def confusion_counts(df: DataFrame, keys: list[str], gold: str, pred: str) -> DataFrame:
    return df.groupBy(*keys, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def class_table(counts: DataFrame, keys: list[str], labels: list | None = None) -> DataFrame:
    """Per-class ``tp, gold_n, pred_n`` from confusion counts.

    ``labels=None``: classes are the union of gold and predicted labels in each slice (the
    classification-report default). With a fixed list, absent classes count as zero classes and
    labels outside the list are ignored.
    """
    contrib = F.array(
        F.struct(F.col("gold").alias("cls"), F.col("n").alias("gold_n"), F.lit(0).cast("bigint").alias("pred_n"),
                 F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("gold_n"), F.col("n").alias("pred_n"),
                 F.lit(0).cast("bigint").alias("tp")))
    per = counts.select(*keys, F.explode(contrib).alias("c")).select(*keys, "c.*")
    if labels is not None:
        per = per.where(F.col("cls").isin(*labels))
    out = per.groupBy(*keys, "cls").agg(F.sum("tp").alias("tp"), F.sum("gold_n").alias("support"),
                                        F.sum("pred_n").alias("pred_n"))
    if labels is not None:
        # fixed class list: complete every slice from a bounded per-slice map (no join back)
        per_slice = out.groupBy(*keys).agg(F.map_from_entries(F.collect_list(
            F.struct("cls", F.struct("tp", "support", "pred_n")))).alias("m"))
        g = per_slice.select(*keys, "m", F.explode(F.array(*[F.lit(v) for v in labels])).alias("cls"))
        v = F.try_element_at(F.col("m"), F.col("cls"))
        out = g.select(*keys, "cls", *[F.coalesce(v[c], F.lit(0)).cast("bigint").alias(c)
                                       for c in ("tp", "support", "pred_n")])
    return out.withColumns(_class_metrics())


def _class_metrics() -> dict[str, Column]:
    tp, sup, pn = F.col("tp"), F.col("support"), F.col("pred_n")
    return {
        "precision": F.coalesce(F.try_divide(tp.cast("double"), pn), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide(tp.cast("double"), sup), F.lit(0.0)),
        "f1": F.coalesce(F.try_divide(2.0 * tp, sup + pn), F.lit(0.0)),
    }


def classification_metrics(df: DataFrame, keys: list[str], gold: str, pred: str,
                           labels: list | None = None) -> DataFrame:
    """Macro precision / recall / F1, accuracy and n per slice (0/0 counts as 0)."""
    counts = confusion_counts(df.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()), keys, gold, pred)
    if labels is not None:
        classes = class_table(counts, keys, labels)
        out = classes.groupBy(*keys).agg(
            F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
            F.sum("tp").alias("correct"), F.count(F.lit(1)).alias("n_classes"), F.sum("support").alias("support"))
        return out.select(*keys, "precision", "recall", "f1", "support",
                          F.try_divide(F.col("correct").cast("double"), F.col("support")).alias("acc"),
                          "n_classes")
    # Classes = union of gold and predicted labels of the slice. A slice's confusion cells are few
    # (classes squared), so they are gathered once and the per-class and macro figures computed
    # from that array: one aggregation after the counts instead of two.
    cells = counts.groupBy(*keys).agg(F.collect_list(F.struct(F.col("gold").alias("g"), F.col("pred").alias("p"),
                                                              F.col("n").alias("n"))).alias("c"))
    per_class = F.expr("""transform(array_distinct(concat(transform(c, x -> x.g), transform(c, x -> x.p))), k ->
        named_struct(
          'tp', aggregate(c, 0L, (a, x) -> a + IF(x.g = k AND x.p = k, x.n, 0L)),
          'sup', aggregate(c, 0L, (a, x) -> a + IF(x.g = k, x.n, 0L)),
          'pn', aggregate(c, 0L, (a, x) -> a + IF(x.p = k, x.n, 0L))))""")
    out = cells.select(*keys, per_class.alias("k"))
    metric = {
        "precision": "coalesce(try_divide(CAST(y.tp AS DOUBLE), y.pn), 0.0D)",
        "recall": "coalesce(try_divide(CAST(y.tp AS DOUBLE), y.sup), 0.0D)",
        "f1": "coalesce(try_divide(2.0D * y.tp, y.sup + y.pn), 0.0D)",
    }
    macro = {m: F.expr(f"aggregate(k, 0.0D, (a, y) -> a + {e}) / size(k)") for m, e in metric.items()}
    support = F.expr("aggregate(k, 0L, (a, y) -> a + y.sup)")
    correct = F.expr("aggregate(k, 0L, (a, y) -> a + y.tp)")
    return out.select(*keys, macro["precision"].alias("precision"), macro["recall"].alias("recall"),
                      macro["f1"].alias("f1"), support.alias("support"),
                      F.try_divide(correct.cast("double"), support).alias("acc"),
                      F.size("k").cast("bigint").alias("n_classes"))


def side_performance(pairs: DataFrame, keys: list[str], binary: bool = False,
                     gold: str = "gold_label") -> DataFrame:
    """A10 (+F06 when ``binary``): metrics per slice and side from a polarity frame."""
    pf = pairs if "polarity_1" in pairs.columns else polarity_frame(pairs)
    if binary:
        pf = pf.where(F.col(gold) != "neutral")
    long = sides_long(pf, keys, "polarity_1", "polarity_2", extra=[gold])
    return classification_metrics(long, keys + ["side", "bias_cat"], gold, "pred")


def nested_performance(long: DataFrame, gold: str, pred: str, top: str, sub: str) -> DataFrame:
    """Metrics for (top, sub), (top) and overall in one grouping-set pass over the counts. The
    level comes from the grouping id, so rows whose group is NULL stay a group of their own; totals
    have an empty name. Rows without gold or prediction are left out, as in A09."""
    counts = long.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(top, sub, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))
    sets = counts.groupingSets([[top, sub, "gold", "pred"], [top, "gold", "pred"], ["gold", "pred"]],
                               top, sub, "gold", "pred").agg(F.sum("n").alias("n"), F.grouping_id().alias("__gid"))
    # Bits of the grouping id from the left: top, sub, gold, pred; set where rolled up.
    rolled = {0: "group", 4: top, 12: "all"}
    level = F.element_at(F.create_map(*[F.lit(x) for kv in rolled.items() for x in kv]), F.col("__gid").cast("int"))
    sets = sets.withColumns({"level": level, sub: F.when(F.col("__gid") >= 4, F.lit("")).otherwise(F.col(sub)),
                             top: F.when(F.col("__gid") == 12, F.lit("")).otherwise(F.col(top))}).drop("__gid")
    classes = class_table(sets, ["level", top, sub])
    macro = classes.groupBy("level", top, sub).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.sum("tp").alias("correct"), F.sum("support").alias("support"))
    return macro.select("level", top, sub, "precision", "recall", "f1", "support",
                        F.try_divide(F.col("correct").cast("double"), F.col("support")).alias("acc"))


def classification_report(df: DataFrame, keys: list[str], gold: str, pred: str,
                          labels: list | None = None) -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg`` and ``weighted avg`` rows.

    Columns: ``keys + row, precision, recall, f1, support`` (accuracy row: f1 = accuracy).
    """
    counts = confusion_counts(df.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()), keys, gold, pred)
    classes = class_table(counts, keys, labels)
    # One aggregation per slice over its (few) classes; class rows and summary rows are generated
    # from that bounded array, so the input is read once.
    cs = classes.groupBy(*keys).agg(F.collect_list(F.struct(
        F.col("cls").cast("string").alias("row"), "precision", "recall", "f1", "support", "tp")).alias("cs"))
    k = F.size("cs").cast("double")
    sup = F.aggregate("cs", F.lit(0).cast("bigint"), lambda a, x: a + x["support"])
    tp = F.aggregate("cs", F.lit(0).cast("bigint"), lambda a, x: a + x["tp"])

    def mean(f):
        return F.aggregate("cs", F.lit(0.0), lambda a, x: a + x[f]) / k

    def weighted(f):
        return F.try_divide(F.aggregate("cs", F.lit(0.0), lambda a, x: a + x[f] * x["support"]), sup)

    def row(name, p, r, f1):
        return F.struct(F.lit(name).alias("row"), p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                        f1.cast("double").alias("f1"), sup.alias("support"))

    per_class = F.transform("cs", lambda x: F.struct(x["row"].alias("row"), x["precision"].alias("precision"),
                                                     x["recall"].alias("recall"), x["f1"].alias("f1"),
                                                     x["support"].alias("support")))
    summary = F.array(row("accuracy", F.lit(None), F.lit(None), F.try_divide(tp.cast("double"), sup)),
                      row("macro avg", mean("precision"), mean("recall"), mean("f1")),
                      row("weighted avg", weighted("precision"), weighted("recall"), weighted("f1")))
    return cs.select(*keys, F.explode(F.concat(per_class, summary)).alias("s")).select(*keys, "s.*")


def confusion_matrix(df: DataFrame, keys: list[str], row: str, col: str, labels: list) -> DataFrame:
    """Full ``labels x labels`` grid of counts per slice (rows = first argument).

    One pass: cell counts over all rows (partial aggregation), the slice list taken from those counts
    and the grid generated from the fixed label list; labels outside the list are ignored.
    """
    inside = F.col(row).isin(*labels) & F.col(col).isin(*labels)
    cells = (df.groupBy(*keys, F.when(inside, F.col(row)).alias("row_label"),
                        F.when(inside, F.col(col)).alias("col_label"))
             .agg(F.count(F.lit(1)).alias("n")))
    return _fill_grid(cells, keys, labels)


def _fill_grid(cells: DataFrame, keys: list[str], labels: list) -> DataFrame:
    """Complete the label grid of every slice from its (bounded) cell counts.

    Each slice gathers its at most ``len(labels)**2`` counted cells into a map and the grid is a
    generator over the fixed label list: one aggregation, no join back to the data (a join would let
    the optimizer compute the slice list by a second pass over the input).
    """
    entry = F.when(F.col("row_label").isNotNull(),
                   F.struct(F.struct(F.col("row_label").alias("r"), F.col("col_label").alias("c")), F.col("n")))
    per = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    lab = F.array(*[F.lit(v) for v in labels])
    g = per.select(*keys, "m", F.explode(lab).alias("row_label"))
    g = g.select(*keys, "m", "row_label", F.explode(lab).alias("col_label"))
    n = F.try_element_at(F.col("m"), F.struct(F.col("row_label").alias("r"), F.col("col_label").alias("c")))
    return g.select(*keys, "row_label", "col_label", F.coalesce(n, F.lit(0)).cast("bigint").alias("n"))


def weighted_confusion(df: DataFrame, keys: list[str], row: str, col: str, weight: str, labels: list) -> DataFrame:
    """A14 from one frame: cells summed with a per-row weight (+1 / -1), e.g. the two sides of a
    pair stacked by :func:`sides_long` - one scan instead of a union of two."""
    inside = F.col(row).isin(*labels) & F.col(col).isin(*labels)
    cells = df.groupBy(*keys, F.when(inside, F.col(row)).alias("row_label"),
                       F.when(inside, F.col(col)).alias("col_label")).agg(F.sum(weight).cast("bigint").alias("n"))
    return _fill_grid(cells, keys, labels)


def zero_diagonal(cm: DataFrame) -> DataFrame:
    """Agreements set to zero so disagreements stand out."""
    return cm.withColumn("n", F.when(F.col("row_label") == F.col("col_label"), F.lit(0).cast(cm.schema["n"].dataType))
                         .otherwise(F.col("n")))


def align_results(a: DataFrame, b: DataFrame, keys: list[str], value: str = "label") -> DataFrame:
    """Two result sets side by side on their item keys (equi-join, no row order)."""
    return (a.select(*keys, F.col(value).alias(f"{value}_a"))
            .join(b.select(*keys, F.col(value).alias(f"{value}_b")), keys))
