"""Majority vote over seeds as a native column expression (no UDF).

Votes of one item arrive as ``array<struct<seed_rank:int, label:int>>`` (bounded by the number of
seeds in the run registry, never by the data size). The rule, with n = number of votes:

1. the top count is above ``n // 2``: that label, no disagreement;
2. every vote differs: element ``ceil(n / 2)`` (0-based) of the sorted votes (``tie="compat"``) or
   the lower median ``(n - 1) // 2`` (``tie="median"``), disagreement ("no_winner");
3. otherwise the most frequent label, ties going to the label whose first vote comes first in
   registry order; disagreement ("one_winner" when exactly n - 1 labels are distinct, else "tie").
"""

from __future__ import annotations

from pyspark.sql import functions as F


def with_majority_vote(df, votes: str, prefix: str, tie: str = "compat"):
    """Add ``{prefix}label, {prefix}disagreement, {prefix}kind, {prefix}runner_up``; the runner-up is
    the second label in (count desc, first seen) order for a tie, else NULL.

    Written as Spark SQL text (one JVM-side parse per projection) and staged: intermediate arrays
    get their own projections, which the optimizer keeps separate rather than copying a non-trivial
    expression into every output field.
    """
    if tie not in ("compat", "median"):
        raise ValueError("tie must be 'compat' or 'median'")
    p = f"__{prefix}"
    v = f"`{votes}`"
    df = df.withColumns({
        f"{p}scored": F.expr(f"transform({v}, x -> named_struct('cnt', size(filter({v}, y -> y.label = x.label)), "
                             f"'neg_rank', -x.seed_rank, 'label', x.label))"),
        f"{p}labels": F.expr(f"transform({v}, x -> x.label)"),
        f"{p}n": F.expr(f"size({v})")})
    n = f"`{p}n`"
    pos = f"CAST(ceil({n} / 2) AS INT) + 1" if tie == "compat" else f"CAST(floor(({n} - 1) / 2) AS INT) + 1"
    df = df.withColumns({f"{p}top": F.expr(f"array_max(`{p}scored`)"),
                         f"{p}nd": F.expr(f"size(array_distinct(`{p}labels`))"),
                         f"{p}mid": F.expr(f"try_element_at(array_sort(`{p}labels`), {pos})")})
    top, nd = f"`{p}top`", f"`{p}nd`"
    df = df.withColumns({f"{p}strict": F.expr(f"{top}.cnt > floor({n} / 2)"), f"{p}alldiff": F.expr(f"{nd} = {n}")})
    strict, alldiff = f"`{p}strict`", f"`{p}alldiff`"
    df = df.withColumns({
        f"{prefix}label": F.expr(f"CAST(CASE WHEN {strict} THEN {top}.label WHEN {alldiff} THEN `{p}mid` "
                                 f"ELSE {top}.label END AS INT)"),
        f"{prefix}disagreement": F.expr(f"NOT {strict}"),
        f"{prefix}kind": F.expr(f"CASE WHEN {strict} THEN 'agreement' WHEN {alldiff} THEN 'no_winner' "
                                f"WHEN {nd} = {n} - 1 THEN 'one_winner' ELSE 'tie' END"),
        f"{prefix}runner_up": F.expr(f"CAST(CASE WHEN NOT {strict} AND NOT {alldiff} AND {nd} <> {n} - 1 THEN "
                                     f"array_max(filter(`{p}scored`, s -> s.label <> {top}.label)).label END AS INT)")})
    return df.drop(*[f"{p}{s}" for s in ("scored", "labels", "n", "top", "nd", "mid", "strict", "alldiff")])
