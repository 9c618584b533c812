"""Review preparation (P01, T01, T02, A27, A28, U08, M01, M02, W05, W06, J11, S02 helpers).

Sampling and splitting are keyed by ``md5(seed-id)`` hex strings: reproducible in any engine, no
random state, and the hash-bucket split needs no shuffle at all. Exact first-N selections (class
balance, interleave, small-test subsets) use bucketed positions instead of one window per class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minpair.functions.ranking import first_n, hash_key, positions
from minpair.functions.text import format_text, scrub, scrub_count


def format_data(reviews: DataFrame, body: str = "review_body", title: str = "review_title",
                stars: str = "stars") -> DataFrame:
    """P01 + P17: ``(text = body + title, label = int(stars))`` next to the selected columns."""
    return reviews.select("*", format_text(F.col(body), F.col(title)).alias("text"),
                          F.col(stars).cast("int").alias("label"))


def scrub_reviews(reviews: DataFrame, replacement: str = "_") -> DataFrame:
    """T01 + T02 on body and title (``review_headline`` when there is no ``review_title``)."""
    title = "review_title" if "review_title" in reviews.columns else "review_headline"
    n_body, n_title = scrub_count(F.col("review_body")), scrub_count(F.col(title))
    return reviews.withColumns({
        "n_scrub_body": n_body, "n_scrub_title": n_title, "n_scrubbed": n_body + n_title,
    }).withColumns({"review_body": scrub(F.col("review_body"), replacement),
                    title: scrub(F.col(title), replacement)})


def scrub_stats(scrubbed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, rows changed, total and maximum replacements per slice."""
    return scrubbed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n_scrubbed") > 0).alias("n_changed"),
        F.sum("n_scrubbed").cast("bigint").alias("n_replacements"), F.max("n_scrubbed").alias("max_replacements"))


def class_counts(df: DataFrame, label: str, keys: list[str] | None = None) -> DataFrame:
    """Rows per class, the smallest class size and the share (%) kept after balancing."""
    keys = keys or []
    c = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)  # over the per-class table: a handful of rows per slice
    return c.withColumns({
        "min_class": F.min("n").over(w), "n_classes": F.count(F.lit(1)).over(w), "total": F.sum("n").over(w),
    }).withColumn("kept_pct", F.col("min_class") * F.col("n_classes") * 100.0 / F.col("total"))


def balance_classes(df: DataFrame, label: str, id_col: str, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """Undersample every class to the smallest class size, reproducibly.

    Rows of a class are ranked by ``md5(seed-id)``; ranks come from positions by range, so a class
    holding a third of the data is numbered by many tasks.
    """
    keys = keys or []
    key = hash_key(F.lit(seed), F.col(id_col))
    df = df.withColumn("__h", key)
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__n"))
    limits = counts.withColumn("__limit", F.min("__n").over(Window.partitionBy(*keys))).drop("__n")
    # parts of a large class beyond the smallest class size are cut by the parts' table already
    ranked = first_n(df, [*keys, label], [F.col("__h"), F.col(id_col)], limits, name="__pos")
    return ranked.drop("__h", "__pos")


def hex_to_long(hex_str: Column) -> Column:
    return F.conv(hex_str, 16, 10).cast("bigint")


def split_by_hash(df: DataFrame, id_col: str, seed: int = 42, train: float = 0.95,
                  validation: float = 0.025) -> DataFrame:
    """M02 (scalable mode): split column from ``md5(seed-id)`` in 1/1000 buckets - no shuffle."""
    b = hex_to_long(F.substring(hash_key(F.lit(seed), F.col(id_col)), 1, 8)) % 1000
    t_cut, v_cut = int(round(train * 1000)), int(round((train + validation) * 1000))
    split = F.when(b < t_cut, F.lit("train")).when(b < v_cut, F.lit("validation")).otherwise(F.lit("test"))
    return df.withColumn("split", split)


def split_exact(df: DataFrame, id_col: str, seed: int = 42, test_size: float = 0.05) -> DataFrame:
    """M02 (exact-size mode): ``test = ceil(n * test_size)`` rows by hash order, then the held-out
    part halved the same way (validation first, ``ceil`` half to test).

    One chain: a global hash rank (with the total from the parts' table), then a second rank
    partitioned by the held-out flag (the train rows' second rank is unused).
    """
    d = df.withColumn("__h", hash_key(F.lit(seed), F.lit("a"), F.col(id_col)))
    d = positions(d, [], [F.col("__h"), F.col(id_col)], name="__p1", total_name="__n")
    d = d.withColumn("__held", F.col("__p1") >= F.col("__n") - F.ceil(F.col("__n") * test_size))
    d = d.withColumn("__h2", hash_key(F.lit(seed), F.lit("b"), F.col(id_col)))
    d = positions(d, ["__held"], [F.col("__h2"), F.col(id_col)], name="__p2", total_name="__m")
    n_val = F.col("__m") - F.ceil(F.col("__m") * 0.5)
    split = (F.when(~F.col("__held"), F.lit("train"))
             .when(F.col("__p2") < n_val, F.lit("validation")).otherwise(F.lit("test")))
    return d.select(*df.columns, split.alias("split"))


def interleave(df: DataFrame, source: str, source_idx: Column, order: str) -> DataFrame:
    """Round-robin interleave of sources, stopping at the shortest (k x min rows).

    Adds ``pos`` (position within the source, by ``order``) and ``interleave_pos`` (position in the
    interleaved stream).
    """
    d = df.withColumn("__si", source_idx)
    d = positions(d, [source], [F.col(order)], name="pos")
    counts = d.groupBy(source, "__si").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(F.lit(0))  # over the per-source count table only (one row per source)
    lim = counts.select(source, F.min("__n").over(w).alias("__min"), F.count(F.lit(1)).over(w).alias("__k"),
                        (F.dense_rank().over(w.orderBy("__si")) - 1).alias("__rank"))
    d = d.join(lim, source).where(F.col("pos") < F.col("__min"))
    return d.withColumn("interleave_pos", F.col("pos") * F.col("__k") + F.col("__rank")).drop(
        "__min", "__k", "__si", "__rank")


def first_rows(df: DataFrame, partition: list[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each partition by ``order`` (a small-test subset)."""
    return first_n(df, partition, [F.col(order)], n, name="pos")


def seeded_shuffle(df: DataFrame, partition: list[str], id_col: str, seed: int) -> DataFrame:
    """Position of each row in a seeded shuffle (order by ``md5(seed-id)``)."""
    d = df.withColumn("__h", hash_key(F.lit(seed), F.col(id_col)))
    d = positions(d, partition, [F.col("__h"), F.col(id_col)], name="shuffle_pos")
    return d.drop("__h")


def map_categories(df: DataFrame, mapping: DataFrame, col: str, out: str = "target_category") -> DataFrame:
    """Many-to-one category mapping (left join; ``x`` / unmapped -> NULL).

    The mapping is a dimension (tens of rows in practice).
    """
    m = mapping.select(F.col("source_category").alias(col), F.col("target_category").alias(out), "uncertain")
    return df.join(m, col, "left")
