"""Preference formatting of chat conversations, in native expressions only.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns is rendered
once as the prompt; what follows in either is rendered as its completion, with the spans of
characters that count in training (the assistant's texts and their end markers).

Edge cases: null roles and texts are rendered as empty; turns are equal if role and text are, null
being equal to null; equal conversations give empty completions, as does the shorter one of two if it
is a prefix of the other; a null conversation counts as one without turns, and its completion is
null; markers inside texts are broken up so that they can't end a turn; turns with the same number
are ordered by role and text; a row with a null conversation id is a conversation of its own without
a partner; an empty table gives an empty table; extra columns are not read, and those named like an output column
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minpair.llm.texts import fresh, shield

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
ADDED = ("n_common", "prompt", "chosen_completion", "chosen_spans", "rejected_completion", "rejected_spans")


def _text(x: Column) -> Column:
    return F.replace(F.coalesce(x, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _text(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_text(turn["text"]), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def trained_spans(turns: Column) -> Column:
    """``(start, end)`` in characters of the rendered turns, for each turn of the assistant."""
    span = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(_head(t))
        end = start + F.length(_body(t))
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == TRAINED, F.concat(a["spans"], own)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda a: a["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal."""
    shorter = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), shorter - 1), lambda i: ~(a[i]["role"].eqNullSafe(b[i]["role"]) & a[i]["text"].eqNullSafe(b[i]["text"])))
    return F.when(shorter <= 0, 0).otherwise(F.coalesce(F.array_min(differ), shorter))


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` has two arrays of structs with role and text. All other columns, with ``n_common``,
    ``prompt``, ``chosen_completion``, ``chosen_spans``, ``rejected_completion``, ``rejected_spans``."""
    pairs, back = shield(fresh(pairs, *ADDED), chosen, rejected)
    keep = [c for c in pairs.columns if c not in (chosen, rejected)]
    none = F.array().cast(pairs.schema[chosen].dataType)
    rows = pairs.select(*keep, F.col(chosen).alias("_c"), F.col(rejected).alias("_r"),
                        common_turns(F.coalesce(chosen, none), F.coalesce(rejected, none)).alias("n_common"))

    def rest(x: str) -> Column:
        return F.slice(x, F.col("n_common") + 1, F.greatest(F.size(x) - F.col("n_common"), F.lit(0)))

    # A null side has no common turns: the prompt is then empty.
    return rows.select(*keep, "n_common", render(F.slice(F.coalesce("_c", none), F.lit(1), F.col("n_common"))).alias("prompt"),
                       render(rest("_c")).alias("chosen_completion"), trained_spans(rest("_c")).alias("chosen_spans"),
                       render(rest("_r")).alias("rejected_completion"), trained_spans(rest("_r")).alias("rejected_spans")).withColumnsRenamed(back)


def mismatched_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations ``(conv_id, turn, role, text)``: chosen is the
    conversation up to its last reply of the assistant; in rejected that reply is the partner's last
    one, the partner being the conversation whose id differs in the lowest bit. A conversation
    without a reply is no pair; without a partner's reply rejected is null."""
    turn = F.struct("turn", "role", "text")
    # The rows of both partners meet in one shuffle, by what their ids have in common; ``own`` tells
    # the rows without an id apart.
    rows = conversations.select("conv_id", turn.alias("x"), F.shiftright("conv_id", 1).alias("half"),
                                F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("own"))
    whole = rows.repartition("half", "own").groupBy("half", "own", "conv_id").agg(F.sort_array(F.collect_list("x")).alias("t"))
    places = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.col("t")[i - 1]["role"] == TRAINED)
    cut = whole.withColumn("last", F.array_max(places)).where("last is not null").select(
        "half", "own", "conv_id", F.transform(F.slice("t", 1, F.col("last")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("chosen"))
    both = cut.groupBy("half", "own").agg(F.collect_list(F.struct("conv_id", "chosen")).alias("both")).select(
        F.explode(F.transform("both", lambda a: F.struct(a.alias("own"), F.get(F.filter(
            "both", lambda b: b["conv_id"] != a["conv_id"]), F.lit(0)).alias("partner")))).alias("p"))
    chosen, partner = F.col("p.own.chosen"), F.col("p.partner")
    swapped = F.concat(F.slice(chosen, F.lit(1), F.size(chosen) - 1), F.array(F.element_at(partner["chosen"], -1)))
    return both.select(F.col("p.own.conv_id").alias("conv_id"), partner["conv_id"].alias("partner_id"), chosen.alias("chosen"),
                       F.when(partner.isNotNull(), swapped).alias("rejected"))
