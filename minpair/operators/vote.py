"""Seed ensembling: majority vote (A06), ensemble pairs (A07 + J06), seed mean (A05),
disagreement accounting (A08) and the vote log (T12, A26).

Votes of one item are gathered with ``collect_list`` under a key that includes the item id, so a
group holds at most (sides x seeds) values whatever the data size; the vote itself is a native
array expression. Voting and pair alignment share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minpair.functions.vote import with_majority_vote

PAIR_KEYS = ["lang", "steps", "bias_type", "emotion", "pair_id"]


def vote_items(votes: DataFrame, item_keys: list[str], tie: str = "compat",
               n_seeds: int | None = None) -> DataFrame:
    """One row per item: ``item_keys + (label, disagreement, kind, runner_up, n_votes)``.

    ``n_seeds``: keep only items voted on by every seed (a positional zip stops at the shortest).
    Votes with a NULL label are ignored.
    """
    g = votes.where(F.col("label").isNotNull()).groupBy(*item_keys).agg(F.collect_list(F.struct("seed_rank", "label")).alias("v"))
    if n_seeds is not None:
        g = g.where(F.size("v") == n_seeds)
    out = with_majority_vote(g.withColumn("n_votes", F.size("v")), "v", "", tie)
    return out.select(*item_keys, "label", "disagreement", "kind", "runner_up", "n_votes")


def _side_votes(arr: str, side: int) -> Column:
    return F.expr(f"transform(filter(`{arr}`, x -> x.side = {side}), "
                  f"x -> named_struct('seed_rank', x.seed_rank, 'label', x.label))")


def ensemble_pairs(votes: DataFrame, pair_keys: list[str] | None = None, tie: str = "compat",
                   n_seeds: int | None = None) -> DataFrame:
    """Majority vote of each side of each pair, aligned by ``pair_id`` (A07 + J06, one shuffle).

    P07: ``performance_gap = label_1 - label_2``. J07: ``n_seeds`` keeps items every seed voted on.
    U07: flattening over emotions is just leaving ``emotion`` out of the key.

    Output: ``pair_keys + bias_cat_1, bias_cat_2, label_1, label_2, performance_gap,
    disagreement_1, disagreement_2, kind_1, kind_2, runner_up_1, runner_up_2``.
    Pairs missing a side are dropped (inner alignment).
    """
    pair_keys = pair_keys or PAIR_KEYS
    # Only collect_list (an object-hash aggregate with map-side partial merge): string max() would
    # force a sort-based aggregate. The group name rides along in the struct.
    g = (votes.where(F.col("label").isNotNull()).groupBy(*pair_keys)
         .agg(F.collect_list(F.struct("side", "seed_rank", "label", "grp")).alias("v")))
    s1, s2 = _side_votes("v", 1), _side_votes("v", 2)
    g = g.select(*pair_keys, _side_name("v", 1).alias("bias_cat_1"),
                 _side_name("v", 2).alias("bias_cat_2"), s1.alias("v1"), s2.alias("v2"))
    cond = (F.size("v1") > 0) & (F.size("v2") > 0)
    if n_seeds is not None:
        cond = (F.size("v1") == n_seeds) & (F.size("v2") == n_seeds)
    g = g.where(cond)
    w = with_majority_vote(with_majority_vote(g, "v1", "s1_", tie), "v2", "s2_", tie)
    return w.select(
        *pair_keys, "bias_cat_1", "bias_cat_2",
        F.col("s1_label").alias("label_1"), F.col("s2_label").alias("label_2"),
        (F.col("s1_label") - F.col("s2_label")).alias("performance_gap"),
        F.col("s1_disagreement").alias("disagreement_1"), F.col("s2_disagreement").alias("disagreement_2"),
        F.col("s1_kind").alias("kind_1"), F.col("s2_kind").alias("kind_2"),
        F.col("s1_runner_up").alias("runner_up_1"), F.col("s2_runner_up").alias("runner_up_2"),
    )


def _side_name(arr: str, side: int) -> Column:
    return F.expr(f"element_at(filter(`{arr}`, x -> x.side = {side}), 1).grp")


def _sided(votes: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Collect ``(side, value, grp)`` per key: both sides of a pair in one object-hash aggregate."""
    g = votes.groupBy(*keys).agg(F.collect_list(F.struct(F.col("side"), value.alias("x"), F.col("grp"))).alias("v"))
    return g.select(*keys, "v", _side_name("v", 1).alias("bias_cat_1"),
                    _side_name("v", 2).alias("bias_cat_2"))


def align_sides(df: DataFrame, keys: list[str], value: str = "label") -> DataFrame:
    """J06 for any per-side table ``(keys..., side, grp, value)``: one row per pair with
    ``label_1, label_2, bias_cat_1, bias_cat_2`` (pairs missing a side are dropped)."""
    g = _sided(df, keys, F.col(value))
    pick = lambda side: F.expr(f"element_at(filter(v, e -> e.side = {side}), 1).x")
    g = g.select(*keys, "bias_cat_1", "bias_cat_2", pick(1).alias("label_1"), pick(2).alias("label_2"))
    return g.where(F.col("label_1").isNotNull() & F.col("label_2").isNotNull())


def seed_pairs(votes: DataFrame, pair_keys: list[str] | None = None) -> DataFrame:
    """Per-run pair alignment (J06 per seed): ``pair_keys + seed, label_1, label_2, gap``."""
    keys = (pair_keys or PAIR_KEYS) + ["seed"]
    g = _sided(votes, keys, F.col("label"))
    pick = lambda side: F.expr(f"element_at(filter(v, e -> e.side = {side}), 1).x")
    g = g.select(*keys, "bias_cat_1", "bias_cat_2", pick(1).alias("label_1"), pick(2).alias("label_2"))
    g = g.where(F.col("label_1").isNotNull() & F.col("label_2").isNotNull())
    return g.withColumn("performance_gap", F.col("label_1") - F.col("label_2"))


def mean_pairs(votes: DataFrame, pair_keys: list[str] | None = None) -> DataFrame:
    """Item-wise mean label over seeds for each side, aligned by pair."""
    keys = pair_keys or PAIR_KEYS
    g = _sided(votes, keys, F.col("label"))

    def mean(side):
        xs = f"transform(filter(v, e -> e.side = {side}), e -> CAST(e.x AS DOUBLE))"
        return F.expr(f"try_divide(aggregate({xs}, 0.0D, (acc, y) -> acc + y), size({xs}))")

    g = g.select(*keys, "bias_cat_1", "bias_cat_2", mean(1).alias("label_1"), mean(2).alias("label_2"))
    g = g.where(F.col("label_1").isNotNull() & F.col("label_2").isNotNull())
    return g.withColumn("performance_gap", F.col("label_1") - F.col("label_2"))


def disagreement_stats(voted: DataFrame, slice_keys: list[str]) -> DataFrame:
    """Items, disagreements and rate (%) per slice, plus a total row per bias type.

    ``voted`` is the output of :func:`vote_items`. ``slice_keys`` must contain ``bias_type``;
    total rows carry NULL in the other keys and ``level = 'total'``. One grouping-set aggregation,
    so the votes are read once.
    """
    agg = [F.count(F.lit(1)).alias("n_items"),
           F.sum(F.col("disagreement").cast("bigint")).alias("n_disagreements"),
           F.grouping_id().alias("__gid")]
    g = voted.groupingSets([slice_keys, ["bias_type"]], *slice_keys).agg(*agg)
    g = g.withColumn("level", F.when(F.col("__gid") == 0, F.lit("detail")).otherwise(F.lit("total"))).drop("__gid")
    return g.withColumn("disagreement_pct", F.try_divide(F.col("n_disagreements") * 100.0, F.col("n_items")))


def disagreement_items(voted: DataFrame) -> DataFrame:
    """The disagreeing items as a long table (the reference's index list, without one big array)."""
    return voted.where("disagreement")


# --- vote log (T12, A26) ---------------------------------------------------------------------------

def render_vote_log(voted: DataFrame) -> DataFrame:
    """One log line per disagreement, in the message format of the evaluated scripts."""
    from minpair.plans.dims import VOTE_LOG_MESSAGES as M
    line = (F.when(F.col("kind") == "no_winner", F.lit(M["no_winner"]))
            .when(F.col("kind") == "one_winner", F.lit(M["one_winner"]))
            .otherwise(F.concat(F.lit(M["tie"]), F.col("label").cast("string"), F.lit(", "),
                                F.col("runner_up").cast("string"), F.lit(" "))))
    return voted.where("disagreement").select(line.alias("value"))


def parse_vote_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """T12 + F10: ``(kind, label_a, label_b, tie_pair)`` for every line starting with ``disagreement``."""
    v = F.col(col)
    d = lines.where(v.startswith("disagreement"))
    kind = (F.when(v.startswith("disagreement, only one vote has more"), F.lit("one_winner"))
            .when(v.startswith("disagreement, two labels are tied"), F.lit("tie"))
            .otherwise(F.lit("no_winner")))
    a = F.regexp_extract(v, r"labels:\s*(-?\d+)\s*,\s*(-?\d+)", 1)
    b = F.regexp_extract(v, r"labels:\s*(-?\d+)\s*,\s*(-?\d+)", 2)
    is_tie = kind == "tie"
    la = F.when(is_tie, a.cast("int"))
    lb = F.when(is_tie, b.cast("int"))
    pair = F.when(is_tie, F.concat_ws("+", F.least(la, lb).cast("string"), F.greatest(la, lb).cast("string")))
    return d.select(kind.alias("kind"), la.alias("label_a"), lb.alias("label_b"), pair.alias("tie_pair"))


def vote_log_shares(parsed: DataFrame) -> DataFrame:
    """Count and share (%) of each disagreement kind."""
    counts = parsed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    # At most three rows after the aggregation: a global window over them is free.
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("kind", "n", F.try_divide(F.col("n") * 100.0, total).alias("share_pct"))


def tie_ranking(parsed: DataFrame) -> DataFrame:
    """Tie label pairs by frequency (ties broken by the pair text, W07)."""
    return (parsed.where(F.col("kind") == "tie").groupBy("tie_pair")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tie_pair"))
