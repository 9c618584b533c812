"""Majority-vote rule goldens and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from minpair.functions.vote import with_majority_vote


def _vote(spark, votes, tie="compat"):
    arr = [{"seed_rank": i, "label": v} for i, v in enumerate(votes)]
    df = spark.createDataFrame([(arr,)], "v array<struct<seed_rank:int,label:int>>")
    r = with_majority_vote(df, "v", "", tie).first()
    return r["label"], r["disagreement"], r["kind"], r["runner_up"]


@pytest.mark.parametrize("votes,expected", [
    ([3, 3, 3, 1, 2], (3, False, "agreement")),
    ([1, 2, 3, 4, 5], (4, True, "no_winner")),
    ([2, 5, 1, 5, 3], (5, True, "one_winner")),
    ([4, 2, 4, 2, 1], (4, True, "tie")),
    ([2, 4, 4, 2, 1], (2, True, "tie")),
    ([1, 5], (5, True, "no_winner")),
    ([4], (4, False, "agreement")),
])
def test_vote_goldens(spark, votes, expected):
    assert _vote(spark, votes)[:3] == expected


def test_vote_median_option(spark):
    assert _vote(spark, [1, 2, 3, 4, 5], tie="median")[0] == 3


def test_tie_runner_up(spark):
    assert _vote(spark, [4, 2, 4, 2, 1])[3] == 2
    assert _vote(spark, [2, 4, 4, 2, 1])[3] == 4


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=7))
def test_vote_keeps_the_rule(spark, votes):
    """The written rule, checked on the result: a label with more than half of the votes wins without
    disagreement; of votes that all differ the one wins that ceil(n / 2) others are below; else no
    label has more votes than the winner, and none with as many was cast earlier."""
    label, disagreement = _vote(spark, votes)[:2]
    share = {x: votes.count(x) for x in votes}
    assert disagreement == all(2 * k <= len(votes) - len(votes) % 2 for k in share.values())
    if not disagreement:
        assert 2 * share[label] > len(votes) - len(votes) % 2
    elif len(share) == len(votes):
        assert sum(x < label for x in votes) == (len(votes) + 1) // 2
    else:
        assert max(share.values()) == share[label]
        assert all(share[x] < share[label] for x in votes[:votes.index(label)])


def test_vote_log_tie_ranking(spark):
    """Tie lines as logged by the study (label pairs from its sample output) parse back to pair counts."""
    from collections import Counter
    from minpair.operators.vote import parse_vote_log, tie_ranking, vote_log_shares
    pairs = [(2, 3), (4, 5), (3, 4), (3, 5), (2, 3), (2, 3), (1, 5), (3, 4), (4, 5), (3, 4), (4, 5), (3, 5),
             (4, 5), (5, 3), (3, 5), (3, 1), (1, 3), (1, 3), (1, 3), (1, 3), (1, 3), (1, 2), (5, 3)]
    lines = [f"disagreement, two labels are tied, arbitrarily picking one, labels: {a}, {b} " for a, b in pairs]
    lines += ["disagreement, all different votes, returning middle",
              "disagreement, only one vote has more, using it", "Results for models at 100 steps:"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    parsed = parse_vote_log(df)
    got = {r["tie_pair"]: r["n"] for r in tie_ranking(parsed).collect()}
    exp = Counter("+".join(str(x) for x in sorted(p)) for p in pairs)
    assert got == dict(exp)
    shares = {r["kind"]: r["n"] for r in vote_log_shares(parsed).collect()}
    assert shares == {"tie": len(pairs), "no_winner": 1, "one_winner": 1}


def test_ensemble_pairs_ignores_null_votes_and_requires_all_seeds(spark):
    from minpair.operators.vote import ensemble_pairs
    rows = []
    for seed_rank, (l1, l2) in enumerate([(5, 1), (5, 2), (4, 2)]):
        rows += [("de", 1, "gender", "joy", 7, seed_rank, 1, "male", l1), ("de", 1, "gender", "joy", 7, seed_rank, 2, "female", l2)]
    rows.append(("de", 1, "gender", "joy", 8, 0, 1, "male", 3))          # pair 8 misses side 2
    rows.append(("de", 1, "gender", "joy", 7, 3, 1, "male", None))       # NULL vote ignored
    df = spark.createDataFrame(rows, "lang string, steps int, bias_type string, emotion string, pair_id long, "
                                     "seed_rank int, side int, grp string, label int")
    out = ensemble_pairs(df, n_seeds=3).collect()
    assert [(r.pair_id, r.label_1, r.label_2, r.bias_cat_1, r.bias_cat_2) for r in out] == [(7, 5, 2, "male", "female")]
