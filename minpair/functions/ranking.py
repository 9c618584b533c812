"""Exact positions, running sums and first-N selections without one giant window partition.

``row_number() OVER (PARTITION BY p ORDER BY k)`` sends a whole partition ``p`` to one task; when ``p`` has
few values (labels, sources, languages) one task would see a third of the data. Here rows are dealt by
range of (``p``, ``k``) into parts of about equal size, whose boundaries Spark samples, so a large
partition spreads over many parts however sparse its keys are. Rows are numbered within their part;
each part's counts by ``p`` become offsets by prefix sums over the parts, and a window sees one row for each
part that a partition touches, never the rows. The result equals the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minpair.session import materialise

#: Rows of a parts' table up to which it is broadcast; a larger one is joined by shuffle.
MOST_BROADCAST = 100_000


def hash_key(*cols: Column | str) -> Column:
    """Engine-independent hex ordering key: ``md5`` of the ``-``-joined values."""
    return F.md5(F.concat_ws("-", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                     for c in cols]))


def dealt(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Rows dealt by range of ``order`` and sorted within their part, written once (the boundaries are
    sampled, so a second run could draw others); with the part's number ``__part``, which rises in the
    order, and the row's place in it ``__idx``."""
    rows = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order))
    rows = rows.withColumn("__id", F.monotonically_increasing_id())
    return rows.withColumn("__part", F.shiftright("__id", 33).cast("int")).withColumn(
        "__idx", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")


def sent_if_few(table: DataFrame) -> DataFrame:
    """The table marked for broadcast if a look at it finds few rows, else as it is."""
    return F.broadcast(table) if table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else table


def least_common(table: DataFrame, count: str, most: int) -> int:
    """The smallest count that at most ``most`` rows reach. The histogram of the counts comes to the driver;
    it has at most the root of twice their sum of rows."""
    rows, least = 0, None
    for r in sorted(table.groupBy(F.col(count).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["c"]):
        rows += r["n"]
        if rows > most:
            return r["c"] + 1
        least = r["c"]
    return least or 0


def attach(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join to a table that has one row for each of ``keys`` (NULL is a value), broadcast if it
    has few rows."""
    return _null_safe_join(df, sent_if_few(table), keys)


def positions(df: DataFrame, partition: list[str], order: list[Column | str], name: str = "pos",
              total_name: str | None = None, limit: int | DataFrame | None = None) -> DataFrame:
    """Add the 0-based ``row_number - 1`` of each row within ``partition`` ordered by ``order``.

    ``total_name``: also add the partition's row count (from the parts' table, no extra pass).
    ``limit``: only rows with position below it are wanted - an int, or a DataFrame of ``partition``
    columns plus ``__limit``. Parts that start at or beyond the limit drop out by the parts' table.
    """
    rows = dealt(df, [*[F.col(p) for p in partition], *order])
    parts = materialise(rows.groupBy("__part", *partition).agg(F.min("__idx").alias("__first"), F.count(F.lit(1)).alias("__cnt")))
    group = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("__off", F.coalesce(F.sum("__cnt").over(before), F.lit(0)))
    if total_name:
        offsets = offsets.withColumn(total_name, F.sum("__cnt").over(group))
    if isinstance(limit, int):
        offsets = offsets.where(F.col("__off") < limit).withColumn("__limit", F.lit(limit))
    elif limit is not None:
        offsets = _null_safe_join(offsets, limit, partition).where(F.col("__off") < F.col("__limit"))
    out = attach(rows, offsets.drop("__cnt"), ["__part", *partition])
    out = out.withColumn(name, F.col("__off") + F.col("__idx") - F.col("__first"))
    if limit is not None:
        out = out.where(F.col(name) < F.col("__limit")).drop("__limit")
    return out.drop("__off", "__part", "__idx", "__first")


def cumulative(cells: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """``cells`` (one row for each of ``keys`` and ``value``) with ``{s}_before`` (what smaller values of the
    slice add up to) and ``{s}_total`` for each of ``sums``, and ``next_value``. A slice spreads over parts; a
    window sees a slice's rows within one part, or one row for each part it touches."""
    rows = dealt(cells, [*[F.col(k) for k in keys], F.col(value)]).drop("__idx")
    parts = materialise(rows.groupBy("__part", *keys).agg(*[F.sum(s).alias(f"__{s}") for s in sums], F.min(value).alias("__first")))
    slice_ = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = slice_.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__part", *keys, F.lead("__first").over(slice_.orderBy("__part")).alias("__next"),
                           *[F.coalesce(F.sum(f"__{s}").over(earlier), F.lit(0)).alias(f"__{s}_off") for s in sums],
                           *[F.sum(f"__{s}").over(slice_).alias(f"{s}_total") for s in sums])
    inside = Window.partitionBy("__part", *keys).orderBy(value)
    smaller = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"__{s}_in": F.coalesce(F.sum(s).over(smaller), F.lit(0)) for s in sums} | {"__lead": F.lead(value).over(inside)})
    out = attach(rows, offsets, ["__part", *keys])
    return out.select(*cells.columns, *[(F.col(f"__{s}_off") + F.col(f"__{s}_in")).alias(f"{s}_before") for s in sums],
                      *[f"{s}_total" for s in sums], F.coalesce("__lead", "__next").alias("next_value"))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` treating NULL as a value (``<=>``); the keys appear once."""
    if not keys:  # only for a global (one-row) limit table
        return left.join(F.broadcast(right))
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond).drop(*[f"__r_{k}" for k in keys])


def first_n(df: DataFrame, partition: list[str], order: list[Column | str], n: int | DataFrame, name: str = "pos") -> DataFrame:
    """Rows whose position within ``partition`` is below ``n``: an int, for which every task keeps its own
    first ``n`` rows before the shuffle, or a per-partition limit table (see :func:`positions`)."""
    if not isinstance(n, int):
        return positions(df, partition, order, name, limit=n)
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n).withColumn(name, F.col(name).cast("long") - 1)
