"""Mixing sources to target weights by capped water-filling, in native expressions only.

Weights share the total of all sizes. A source whose share is more than ``max_epochs`` times its own
size is clamped there, and the excess goes to the others by weight, until no source is above. A
source's rate, target over size, is then split: every row is taken the whole number of times, and
the fraction is filled with rows in a seeded order up to the row nearest to it.

The seeded order is a hash of the row, and its cut is found in two steps, a histogram of 4096 slices
for each source and the rows of the one slice that holds the cut. So no task gets a source's rows:
the histogram is summed before the shuffle, and whether a row is taken depends on the row and its
source's line of the plan alone.

Edge cases: a null text has size 0; a null source is a source of its own, sorted last; rows of size
0 are never needed to reach a target and follow the same rule; rows equal in id and text are taken
alike; sources of size 0 and an empty table give target 0; input columns named like an output column
are replaced by ``mix`` and come back as they were from ``repeat``; any other column passes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from minpair.llm.texts import fresh, private, shield, word_count
from minpair.session import materialise

#: Slices of the seeded order: its 12 leading bits.
SLICES = 4096
#: Lines of the plan, one for each source, up to which they are broadcast; more are joined by shuffle.
BROADCAST_LINES = 100_000
ADDED = ("size", "source_size", "target", "copies", "taken")


def seeded_order(doc_id: Column, text: Column, seed: int) -> Column:
    """Pseudo-random place of a row within its source, 60 bits of an MD5; equal rows share a place."""
    parts = [F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _by_line(rows: DataFrame, lines: DataFrame, on: Column) -> DataFrame:
    few = lines.count() <= BROADCAST_LINES
    return rows.join(F.broadcast(lines) if few else lines, on)


def _slice(order: Column) -> Column:
    return F.shiftright(order, 48).cast("int")


def number_sources(totals: DataFrame) -> DataFrame:
    """``totals`` with ``rank`` from 0 by code point, null last: rows are dealt by range, numbered
    within their part, and the parts' offsets (one row each) are added."""
    dealt = materialise(totals.repartitionByRange(F.col("source").isNull(), F.col("source"))
                        .sortWithinPartitions(F.col("source").isNull(), F.col("source")))
    numbered = dealt.withColumn("_n", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_n", 33))
    offsets = numbered.groupBy("_part").agg(F.count("*").alias("_c")).withColumn(
        "_before", F.sum("_c").over(W.orderBy("_part")) - F.col("_c"))
    return numbered.join(offsets, "_part").withColumn(
        "rank", F.col("_before") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))).select(*totals.columns, "rank")


def water_fill(totals: DataFrame, max_epochs: float) -> DataFrame:
    """``totals`` (source, source_size, weight) with ``target``. Each round shares what the clamped
    sources leave; one row of sums a round comes to the driver."""
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    state = materialise(totals.withColumn("clamped", F.col("source_size") == 0))
    first = state.agg(F.sum("source_size").alias("s")).first()
    while True:
        sums = state.agg(F.sum(F.when(F.col("clamped"), cap)).alias("used"), F.count(F.when(F.col("clamped"), 1)).alias("n"),
                         F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("w")).first()
        level = ((first["s"] or 0) - (sums["used"] or 0.0)) / sums["w"] if sums["w"] else 0.0
        above = state.withColumn("clamped", F.col("clamped") | (F.col("weight") * F.lit(level) > cap))
        if above.where("clamped").count() == sums["n"]:
            return state.withColumn("target", F.when(F.col("clamped"), cap).otherwise(F.col("weight") * F.lit(level)))
        state = materialise(above)


def plan(rows: DataFrame, cycle: tuple[float, ...], max_epochs: float) -> DataFrame:
    """One line for each source: its size, target, whole repetitions, and the last place in the
    seeded order (``cut``) that gets one more. ``rows`` has source, size and place."""
    slices = rows.groupBy("source", _slice(F.col("place")).alias("slice")).agg(F.sum("size").alias("size"))
    slices = materialise(slices)
    totals = number_sources(slices.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("rank") % len(cycle) + 1).cast("int"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    lines = materialise(water_fill(totals.withColumn("weight", weight), max_epochs).withColumn("rate", rate).select(
        F.col("source").alias("p_source"), "source_size", "target", F.floor("rate").alias("whole"),
        ((F.col("rate") - F.floor("rate")) * F.col("source_size")).alias("part")))
    same = F.col("source").eqNullSafe(F.col("p_source"))
    upto = F.sum("size").over(W.partitionBy("source").orderBy("slice"))
    held = (slices.withColumn("before", upto - F.col("size")).join(lines, same)
            .where((F.col("before") < F.col("part")) & (F.col("before") + F.col("size") >= F.col("part")))
            .select("p_source", F.col("slice").alias("p_slice"), F.col("part") - F.col("before")))
    held = materialise(held.toDF("p_source", "p_slice", "rest"))
    near = _by_line(rows.withColumn("slice", _slice(F.col("place"))),
                    held, same & (F.col("slice") == F.col("p_slice"))).groupBy("source", "rest", "slice", "place").agg(F.sum("size").alias("size"))
    reached = F.sum("size").over(W.partitionBy("source").orderBy("place"))
    cuts = near.withColumn("reached", reached).groupBy("source", "slice").agg(
        F.max(F.when(F.col("reached") - F.col("size") / 2 <= F.col("rest"), F.col("place"))).alias("place"))
    # No row of the slice taken: the cut lies just before the slice (null: before all rows).
    cuts = cuts.select(F.col("source").alias("c_source"), F.coalesce("place", F.when(
        F.col("slice") > 0, F.shiftleft(F.col("slice").cast("long"), 48) - 1)).alias("cut"))
    return materialise(lines.join(cuts, F.col("p_source").eqNullSafe(F.col("c_source")), "left").drop("c_source", "part"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        cycle: tuple[float, ...] = (1, 2, 3), max_epochs: float = 3, seed: int = 17) -> DataFrame:
    """All input columns with ``size`` (words), ``source_size``, ``target``, ``copies`` (times the
    row is taken) and ``taken`` (words taken, repeats counted). ``cycle``: weights of the sources in
    the order of their names, repeating."""
    docs, back = shield(fresh(docs, *ADDED), doc_id, text, source)
    sized = docs.withColumn("size", word_count(F.col(text))).withColumn(
        "place", seeded_order(F.col(doc_id), F.col(text), seed))
    lines = plan(materialise(sized.select(F.col(source).alias("source"), "size", "place")), cycle, max_epochs)
    extra = (F.col("place") <= F.col("cut")).cast("long")
    return (_by_line(sized, lines, F.col(source).eqNullSafe(F.col("p_source")))
            .withColumn("copies", F.col("whole") + F.coalesce(extra, F.lit(0)))
            .withColumn("taken", F.col("size") * F.col("copies"))
            .select(*docs.columns, *ADDED).withColumnsRenamed(back))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of each row as many times as it is taken."""
    number, = private("number")
    return mixed.where("copies > 0").withColumn(number, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        *[F.col(f"`{c}`") for c in columns])


def repeat(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, unchanged, as many times as ``mix`` takes them."""
    rows, back = shield(docs, doc_id, text, source)
    return repeated(mix(rows, doc_id, text, source, **options), rows.columns).withColumnsRenamed(back)
