"""Oracle SQL (DuckDB dialect) for every registered report that plain SQL can express."""

from __future__ import annotations

from minpair.plans.sqlkit import (bias_stats_select, ensemble_cte, r6, t_p_sql, t_sql, vote_cte,
                                  votes_cte)

ORACLE: dict[str, str] = {}

ITEM = ["lang", "steps", "bias_type", "emotion", "side", "pair_id"]


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORACLE["a04_ensemble_bias_by_emotion"] = _with(votes_cte(), ensemble_cte()) + bias_stats_select(
    "ens", ["lang", "bias_type", "emotion", "steps"])

ORACLE["a03_ensemble_bias"] = _with(votes_cte(), ensemble_cte()) + bias_stats_select(
    "ens", ["lang", "bias_type", "steps"])

_SEED_PAIRS = """seed_pairs AS (
  SELECT lang, steps, bias_type, emotion, pair_id, seed,
    max(CASE WHEN side = 1 THEN label END) AS label_1, max(CASE WHEN side = 2 THEN label END) AS label_2,
    max(CASE WHEN side = 1 THEN grp END) AS bias_cat_1, max(CASE WHEN side = 2 THEN grp END) AS bias_cat_2
  FROM votes GROUP BY lang, steps, bias_type, emotion, pair_id, seed
)"""

ORACLE["a03_bias_per_seed"] = _with(votes_cte(), _SEED_PAIRS) + bias_stats_select(
    "seed_pairs", ["lang", "seed", "bias_type", "steps"])

ORACLE["a04_bias_per_seed_by_emotion"] = _with(votes_cte(), _SEED_PAIRS) + bias_stats_select(
    "seed_pairs", ["lang", "seed", "bias_type", "emotion", "steps"])

_MEAN_PAIRS = """mean_pairs AS (
  SELECT lang, steps, bias_type, emotion, pair_id,
    avg(CASE WHEN side = 1 THEN label END) AS label_1, avg(CASE WHEN side = 2 THEN label END) AS label_2,
    max(CASE WHEN side = 1 THEN grp END) AS bias_cat_1, max(CASE WHEN side = 2 THEN grp END) AS bias_cat_2
  FROM votes GROUP BY lang, steps, bias_type, emotion, pair_id
)"""

ORACLE["a05_seed_mean_bias"] = _with(votes_cte(), _MEAN_PAIRS) + bias_stats_select(
    "mean_pairs", ["lang", "bias_type", "steps"])

_T = t_sql("n_pairs", "md", "sd")
ORACLE["a01_paired_ttest_events"] = f"""WITH span AS (
  SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS mid FROM events
), per_user AS (
  SELECT event_type, user_id,
    avg(CASE WHEN epoch_us(ts) < mid THEN value END) AS label_1,
    avg(CASE WHEN epoch_us(ts) >= mid THEN value END) AS label_2
  FROM events, span GROUP BY event_type, user_id
), agg AS (
  SELECT event_type, count(label_1 - label_2) AS n_pairs, avg(label_1 - label_2) AS md,
         stddev_samp(label_1 - label_2) AS sd
  FROM per_user GROUP BY event_type
), tt AS (SELECT *, {_T} AS t FROM agg)
SELECT event_type, n_pairs, {r6('md')} AS mean_diff, {r6('sd')} AS sd_diff, {r6('t')} AS t_statistic,
       {r6(t_p_sql('t', 'n_pairs - 1'))} AS statistical_significance
FROM tt"""

ORACLE["a06_majority_vote"] = _with(votes_cte(), vote_cte("vt", "votes", ITEM)) + "SELECT * FROM vt"
ORACLE["a06_majority_vote_median"] = (_with(votes_cte(), vote_cte("vt", "votes", ITEM, tie="median"))
                                      + "SELECT * FROM vt")

ORACLE["j06_ensemble_pairs"] = _with(votes_cte(), ensemble_cte()) + """SELECT lang, steps, bias_type, emotion,
  pair_id, bias_cat_1, bias_cat_2, label_1, label_2, label_1 - label_2 AS performance_gap,
  disagreement_1, disagreement_2, kind_1, kind_2, runner_up_1, runner_up_2 FROM ens"""

_ITEM_G = ITEM + ["grp"]
ORACLE["a08_disagreements"] = _with(votes_cte(), vote_cte("vt", "votes", _ITEM_G)) + """,
detail AS (
  SELECT bias_type, grp, steps, count(*) AS n_items, CAST(sum(CAST(disagreement AS INTEGER)) AS BIGINT) AS n_disagreements,
         'detail' AS level
  FROM vt GROUP BY bias_type, grp, steps
), total AS (
  SELECT bias_type, CAST(NULL AS VARCHAR) AS grp, CAST(NULL AS INTEGER) AS steps, count(*) AS n_items,
         CAST(sum(CAST(disagreement AS INTEGER)) AS BIGINT) AS n_disagreements, 'total' AS level
  FROM vt GROUP BY bias_type
)
SELECT *, round(n_disagreements * 100.0 / n_items, 6) AS disagreement_pct FROM (
  SELECT * FROM detail UNION ALL SELECT * FROM total) u"""

_LOG = """log_parsed AS (
  SELECT kind,
    CASE WHEN kind = 'tie' THEN label END AS label_a,
    CASE WHEN kind = 'tie' THEN runner_up END AS label_b
  FROM vt WHERE disagreement
)"""

ORACLE["t12_parse_vote_log"] = _with(votes_cte(), vote_cte("vt", "votes", ITEM), _LOG) + """SELECT kind, label_a,
  label_b, CASE WHEN kind = 'tie' THEN CAST(least(label_a, label_b) AS VARCHAR) || '+' ||
  CAST(greatest(label_a, label_b) AS VARCHAR) END AS tie_pair FROM log_parsed"""

ORACLE["a26_vote_log_shares"] = _with(votes_cte(), vote_cte("vt", "votes", ITEM), _LOG) + """SELECT kind,
  count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct
FROM log_parsed GROUP BY kind"""

ORACLE["a26_tie_ranking"] = _with(votes_cte(), vote_cte("vt", "votes", ITEM), _LOG) + """SELECT
  CAST(least(label_a, label_b) AS VARCHAR) || '+' || CAST(greatest(label_a, label_b) AS VARCHAR) AS tie_pair,
  count(*) AS n
FROM log_parsed WHERE kind = 'tie' GROUP BY 1"""


# --- performance ----------------------------------------------------------------------------------

from minpair.plans.sqlkit import class_table_ctes, confusion_sql, metrics_select, report_select  # noqa: E402


def _pol(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 3 THEN 'positive' WHEN {x} < 3 THEN 'negative' ELSE 'neutral' END)"


def _pint(x: str) -> str:
    return f"(CASE WHEN {x} = 'negative' THEN 0 WHEN {x} = 'neutral' THEN 1 WHEN {x} = 'positive' THEN 2 END)"


_GOLD = ("(CASE WHEN emotion = 'no_emotion' THEN 'neutral' WHEN emotion IN ('anger', 'sadness', 'fear') "
         "THEN 'negative' WHEN emotion = 'joy' THEN 'positive' END)")

_POLARITY = f"""pol0 AS (
  SELECT lang, steps, bias_type, emotion, pair_id, bias_cat_1, bias_cat_2, label_1, label_2,
    {_pol('label_1')} AS polarity_1, {_pol('label_2')} AS polarity_2, {_GOLD} AS gold_label FROM ens
),
pol AS (
  SELECT *, {_pint('gold_label')} AS gold_label_int, {_pint('polarity_1')} AS polarity_1_int,
    {_pint('polarity_2')} AS polarity_2_int, {_pint('polarity_1')} - {_pint('polarity_2')} AS polarity_gap FROM pol0
),
pol_long AS (
  SELECT lang, bias_type, steps, gold_label, 1 AS side, bias_cat_1 AS bias_cat, polarity_1 AS pred FROM pol
  UNION ALL
  SELECT lang, bias_type, steps, gold_label, 2 AS side, bias_cat_2 AS bias_cat, polarity_2 AS pred FROM pol
)"""

_ENS = [votes_cte(), ensemble_cte(), _POLARITY]

ORACLE["p08_polarity_labels"] = _with(*_ENS) + "SELECT * FROM pol"

_SIDE_KEYS = ["lang", "bias_type", "steps", "side", "bias_cat"]
ORACLE["a10_side_performance"] = _with(*_ENS, class_table_ctes("m", "pol_long", _SIDE_KEYS, "gold_label", "pred")) \
    + metrics_select("m", _SIDE_KEYS)
ORACLE["a10_side_performance_binary"] = _with(
    *_ENS, "pol_bin AS (SELECT * FROM pol_long WHERE gold_label <> 'neutral')",
    class_table_ctes("m", "pol_bin", _SIDE_KEYS, "gold_label", "pred")) + metrics_select("m", _SIDE_KEYS)

_NEST = """nest AS (
  SELECT 'group' AS level, bias_type, bias_cat, gold_label, pred FROM pol_long
  UNION ALL SELECT 'bias_type', bias_type, '', gold_label, pred FROM pol_long
  UNION ALL SELECT 'all', '', '', gold_label, pred FROM pol_long
)"""
ORACLE["a11_nested_performance"] = _with(*_ENS, _NEST, class_table_ctes(
    "m", "nest", ["level", "bias_type", "bias_cat"], "gold_label", "pred")) + """SELECT level, bias_type, bias_cat,
  round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1,
  CAST(sum(support) AS BIGINT) AS support, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS acc
FROM m_cls GROUP BY level, bias_type, bias_cat"""

_LABELS = """lab AS (
  SELECT d.lang, l.quality AS gold, l.toxic AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""
ORACLE["a09_label_metrics"] = _with(_LABELS, class_table_ctes("m", "lab", ["lang"], "gold", "pred")) \
    + metrics_select("m", ["lang"])
ORACLE["a12_classification_report"] = _with(_LABELS, class_table_ctes("m", "lab", ["lang"], "gold", "pred", [0, 1])) \
    + report_select("m", ["lang"])
ORACLE["a12_star_report"] = _with(votes_cte(), ensemble_cte(), class_table_ctes(
    "m", "ens", ["lang"], "label_2", "label_1", [1, 2, 3, 4, 5])) + report_select("m", ["lang"])

ORACLE["a13_confusion_matrix"] = _with(votes_cte(), ensemble_cte()) + "SELECT * FROM " + confusion_sql(
    "ens", ["lang", "bias_type", "steps"], "label_1", "label_2", [1, 2, 3, 4, 5]) + " q"

ORACLE["a15_confusion_zero_diagonal"] = _with(votes_cte(), ensemble_cte()) + (
    "SELECT lang, bias_type, steps, row_label, col_label, CASE WHEN row_label = col_label THEN 0 ELSE n END AS n FROM "
    + confusion_sql("ens", ["lang", "bias_type", "steps"], "label_1", "label_2", [1, 2, 3, 4, 5]) + " q")

ORACLE["a14_confusion_difference"] = _with(*_ENS, """diff_src AS (
  SELECT bias_type, steps, gold_label_int, polarity_1_int AS p, 1 AS w FROM pol
  UNION ALL SELECT bias_type, steps, gold_label_int, polarity_2_int AS p, -1 AS w FROM pol
)""") + "SELECT * FROM " + confusion_sql("diff_src", ["bias_type", "steps"], "gold_label_int", "p", [0, 1, 2], "w") + " q"

_TWO = """two AS (
  SELECT a.lang, a.steps, a.bias_type, a.emotion, a.side, a.pair_id, a.label AS label_a, b.label AS label_b
  FROM votes a JOIN votes b ON a.lang = b.lang AND a.steps = b.steps AND a.bias_type = b.bias_type
    AND a.emotion = b.emotion AND a.side = b.side AND a.pair_id = b.pair_id
  WHERE a.seed = 0 AND b.seed = 63
)"""
ORACLE["a32_model_agreement"] = _with(votes_cte(), _TWO) + "SELECT * FROM " + confusion_sql(
    "two", ["lang", "steps"], "label_a", "label_b", [1, 2, 3, 4, 5]) + " q"
ORACLE["a32_model_agreement_report"] = _with(votes_cte(), _TWO, class_table_ctes(
    "m", "two", ["lang", "steps"], "label_a", "label_b", [1, 2, 3, 4, 5])) + report_select("m", ["lang", "steps"])


# --- distributions --------------------------------------------------------------------------------

_STACK = """stacked AS (
  SELECT lang, bias_type, steps, pair_id, 'label_1' AS source, label_1 AS label FROM ens
  UNION ALL SELECT lang, bias_type, steps, pair_id, 'label_2' AS source, label_2 AS label FROM ens
)"""
_ENS2 = [votes_cte(), ensemble_cte()]
ORACLE["u06_stack_labels"] = _with(*_ENS2, _STACK) + "SELECT * FROM stacked"
ORACLE["a16_label_distribution"] = _with(*_ENS2, _STACK) + """SELECT lang, bias_type, steps, source, label,
  count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang, bias_type, steps, source), 6) AS share
FROM stacked GROUP BY lang, bias_type, steps, source, label"""


def _wasserstein_sql(source: str, keys: list[str], sample: str, value: str, a: str, b: str) -> str:
    k = ", ".join(keys)
    return f"""SELECT {k}, round(coalesce(sum(abs(fa - fb) * (nxt - {value})), 0.0), 6) AS wasserstein FROM (
  SELECT {k}, {value},
    sum(na) OVER (PARTITION BY {k} ORDER BY {value} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      / sum(na) OVER (PARTITION BY {k}) AS fa,
    sum(nb) OVER (PARTITION BY {k} ORDER BY {value} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      / sum(nb) OVER (PARTITION BY {k}) AS fb,
    lead({value}) OVER (PARTITION BY {k} ORDER BY {value}) AS nxt
  FROM (SELECT {k}, {value}, sum(CASE WHEN {sample} = {a} THEN 1 ELSE 0 END) AS na,
               sum(CASE WHEN {sample} = {b} THEN 1 ELSE 0 END) AS nb
        FROM {source} GROUP BY {k}, {value}) c
) w GROUP BY {k}"""


ORACLE["a17_wasserstein"] = _with(*_ENS2, _STACK) + _wasserstein_sql(
    "stacked", ["lang", "bias_type", "steps"], "source", "label", "'label_1'", "'label_2'")
ORACLE["a17_wasserstein_seeds"] = _with(votes_cte()) + _wasserstein_sql(
    "(SELECT * FROM votes WHERE seed IN (0, 63))", ["lang", "steps"], "seed", "label", "0", "63")

ORACLE["a19_five_numbers"] = _with(*_ENS2, """q AS (
  SELECT bias_type, steps, count(performance_gap) AS n, CAST(min(performance_gap) AS DOUBLE) AS min,
    CAST(max(performance_gap) AS DOUBLE) AS max,
    quantile_cont(CAST(performance_gap AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(performance_gap AS DOUBLE), 0.5) AS median,
    quantile_cont(CAST(performance_gap AS DOUBLE), 0.75) AS q3
  FROM ens GROUP BY bias_type, steps
)""") + """SELECT q.bias_type, q.steps, q.n, round(q.min, 6) AS min, round(q.max, 6) AS max, round(q1, 6) AS q1,
  round(median, 6) AS median, round(q3, 6) AS q3,
  round(CAST(min(CASE WHEN e.performance_gap >= q1 - 1.5 * (q3 - q1) THEN e.performance_gap END) AS DOUBLE), 6) AS whisker_low,
  round(CAST(max(CASE WHEN e.performance_gap <= q3 + 1.5 * (q3 - q1) THEN e.performance_gap END) AS DOUBLE), 6) AS whisker_high
FROM q JOIN ens e ON e.bias_type = q.bias_type AND e.steps = q.steps
GROUP BY q.bias_type, q.steps, q.n, q.min, q.max, q1, median, q3"""

ORACLE["a21_point_counts"] = _with(votes_cte(), _SEED_PAIRS) + """SELECT seed, bias_type,
  label_1 - label_2 AS performance_gap, count(*) AS n FROM seed_pairs
WHERE label_1 IS NOT NULL AND label_2 IS NOT NULL GROUP BY seed, bias_type, label_1 - label_2"""

ORACLE["a22_min_max"] = _with(votes_cte(), _SEED_PAIRS, """per_run AS (
  SELECT lang, seed, bias_type, steps, avg(CAST(label_1 AS DOUBLE)) - avg(CAST(label_2 AS DOUBLE)) AS performance_gap
  FROM seed_pairs GROUP BY lang, seed, bias_type, steps
)""") + """SELECT bias_type, round(min(performance_gap), 6) AS min_value, round(max(performance_gap), 6) AS max_value
FROM per_run GROUP BY bias_type"""

ORACLE["a18_normal_ci"] = _with(*_ENS2) + """SELECT lang, bias_type, steps, n, round(mean, 6) AS mean, round(sd, 6) AS sd,
  round(mean - 1.96 * sd / sqrt(n), 6) AS ci_low, round(mean + 1.96 * sd / sqrt(n), 6) AS ci_high
FROM (SELECT lang, bias_type, steps, count(performance_gap) AS n, avg(CAST(performance_gap AS DOUBLE)) AS mean,
             stddev_samp(CAST(performance_gap AS DOUBLE)) AS sd FROM ens GROUP BY lang, bias_type, steps) g"""

ORACLE["a20_kde_density"] = _with(*_ENS2, """cells AS (
  SELECT bias_type, steps, CAST(performance_gap AS DOUBLE) AS v, count(*) AS c FROM ens
  WHERE performance_gap IS NOT NULL GROUP BY bias_type, steps, performance_gap
), st AS (
  SELECT bias_type, steps, sum(c) AS n, sum(c * v) / sum(c) AS mean, min(v) AS vmin, max(v) AS vmax,
         sum(c * v * v) AS s2 FROM cells GROUP BY bias_type, steps
), st2 AS (
  SELECT *, sqrt(greatest((s2 - n * mean * mean) / (n - 1), 0.0)) * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM st
), grid AS (
  SELECT bias_type, steps, n, bw, CAST(gi AS INTEGER) AS gi,
         (vmin - 3.0 * bw) + gi * ((vmax - vmin + 6.0 * bw) / 63) AS x
  FROM st2, (SELECT unnest(range(0, 64)) AS gi) r WHERE bw > 0
)""") + """SELECT g.bias_type, g.steps, g.gi, round(g.x, 6) AS x,
  round(sum(c.c * exp(-0.5 * ((g.x - c.v) / g.bw) * ((g.x - c.v) / g.bw))) / (g.n * g.bw * sqrt(2 * pi())), 6) AS density
FROM grid g JOIN cells c ON g.bias_type = c.bias_type AND g.steps = c.steps
GROUP BY g.bias_type, g.steps, g.gi, g.x, g.n, g.bw"""


# --- corpus -------------------------------------------------------------------------------------------

from minpair.plans import corpus_parts as _cp  # noqa: E402
from minpair.plans import dims as _dims  # noqa: E402
from minpair.plans.sqlkit import lit as _lit, values as _vals  # noqa: E402

_GCAT_ROWS = [(lang, role, i, g, _dims.GRAMMAR_PLACEHOLDER[g])
              for lang, roles in _dims.GRAMMAR_CATALOGUE.items() for role, names in roles.items()
              for i, g in enumerate(names)]
_AGREE = ", ".join(_lit(x) for x in _dims.AGREEMENT_LANGS)
_EORDER = ", ".join(_lit(x) for x in _dims.EMOTION_CATEGORIES + [_dims.NO_EMOTION])

_CORPUS_INPUTS = f"""templates AS (SELECT * FROM {_vals(_cp.TEMPLATES, "lang, template_idx, template", "t")}),
emotions AS (SELECT * FROM {_vals(_cp.EMOTIONS, "lang, emotion_idx, emotion_category, emotion_word, grammar_cell, emotion_word_female", "e")}),
gcat AS (SELECT * FROM {_vals(_GCAT_ROWS, "lang, role, grammar_idx, grammar, placeholder", "g")}),
cats AS (SELECT unnest([{", ".join(_lit(c) for c in _dims.EMOTION_CATEGORIES)}]) AS emotion),
tg AS (
  SELECT t.lang, t.template_idx, t.template, g.grammar_idx, g.grammar, g.placeholder
  FROM templates t JOIN gcat g ON g.lang = t.lang AND g.role = 'emotions' WHERE contains(t.template, g.placeholder)
),
words AS (
  SELECT e.*, g.grammar, c.emotion FROM emotions e
  JOIN gcat g ON g.lang = e.lang AND g.role = 'emotions' AND contains(coalesce(e.grammar_cell, ''), g.grammar)
  JOIN cats c ON contains(coalesce(e.emotion_category, ''), c.emotion)
),
filled AS (
  SELECT tg.lang, w.emotion, tg.grammar_idx AS e_grammar_idx, tg.template_idx, w.emotion_idx,
    replace(tg.template, tg.placeholder, w.emotion_word) AS text,
    CASE WHEN tg.lang IN ({_AGREE}) AND tg.grammar = '{_dims.AGREEMENT_GRAMMAR}'
         THEN replace(tg.template, tg.placeholder, w.emotion_word) END AS text_male,
    CASE WHEN tg.lang IN ({_AGREE}) AND tg.grammar = '{_dims.AGREEMENT_GRAMMAR}'
         THEN replace(tg.template, tg.placeholder, coalesce(w.emotion_word_female, w.emotion_word)) END AS text_female
  FROM tg JOIN words w ON w.lang = tg.lang AND w.grammar = tg.grammar
),
sentences AS (
  SELECT * FROM filled
  UNION ALL
  SELECT lang, '{_dims.NO_EMOTION}' AS emotion, -1 AS e_grammar_idx, min(template_idx) AS template_idx, -1 AS emotion_idx,
         template AS text, CAST(NULL AS VARCHAR) AS text_male, CAST(NULL AS VARCHAR) AS text_female
  FROM templates t WHERE NOT EXISTS (SELECT 1 FROM tg WHERE tg.lang = t.lang AND tg.template = t.template)
  GROUP BY lang, template
),
people AS (
  SELECT l.lang, a.c_custkey AS person_idx, ' ' || a.c_name AS person_1,
    CASE WHEN a.c_mktsegment = 'HOUSEHOLD' AND a.c_custkey % 7 = 0 THEN '{_dims.NON_MARKED}' ELSE b.c_name || '  ' END AS person_2,
    CASE WHEN a.c_custkey % 2 = 0 THEN 'male' ELSE 'race: privileged' END AS person_1_type,
    CASE WHEN a.c_custkey % 2 = 0 THEN 'female' ELSE 'race: minoritized' END AS person_2_type,
    CASE WHEN a.c_custkey % 2 = 0 THEN 'gender' ELSE 'race' END AS bias_type,
    CASE WHEN a.c_acctbal < 0 THEN 'subject' ELSE 'subject, object' END AS grammar_cell,
    'male' AS grammar_1, CASE WHEN a.c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS grammar_2
  FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 AND b.c_nationkey = a.c_nationkey
  CROSS JOIN (SELECT unnest(['en', 'es']) AS lang) l
),
pp AS (
  SELECT p.lang, g.grammar, p.person_idx, p.bias_type,
    trim(CASE WHEN p.person_1 = '{_dims.NON_MARKED}' THEN '' ELSE p.person_1 END) AS p1,
    trim(CASE WHEN p.person_2 = '{_dims.NON_MARKED}' THEN '' ELSE p.person_2 END) AS p2,
    trim(p.person_1_type) AS bias_cat_1, trim(p.person_2_type) AS bias_cat_2, trim(grammar_1) AS g1, trim(grammar_2) AS g2
  FROM people p JOIN gcat g ON g.lang = p.lang AND g.role = 'people' AND contains(coalesce(p.grammar_cell, ''), g.grammar)
),
sg AS (
  SELECT s.*, g.grammar_idx, g.grammar, g.placeholder FROM sentences s
  JOIN gcat g ON g.lang = s.lang AND g.role = 'people' WHERE contains(s.text, g.placeholder)
),
cand AS (
  SELECT sg.lang, sg.emotion, pp.bias_type, pp.bias_cat_1, pp.bias_cat_2, sg.grammar_idx AS p_grammar_idx,
    CAST(list_position([{_EORDER}], sg.emotion) AS INTEGER) AS emotion_rank, sg.e_grammar_idx, sg.template_idx,
    sg.emotion_idx, pp.person_idx,
    regexp_replace(replace(CASE WHEN sg.lang IN ({_AGREE}) AND sg.text_female IS NOT NULL
        THEN coalesce(CASE pp.g1 WHEN 'male' THEN sg.text_male WHEN 'female' THEN sg.text_female END, sg.text)
        ELSE sg.text END, sg.placeholder, pp.p1), '\\s+', ' ', 'g') AS sentence_1,
    regexp_replace(replace(CASE WHEN sg.lang IN ({_AGREE}) AND sg.text_female IS NOT NULL
        THEN coalesce(CASE pp.g2 WHEN 'male' THEN sg.text_male WHEN 'female' THEN sg.text_female END, sg.text)
        ELSE sg.text END, sg.placeholder, pp.p2), '\\s+', ' ', 'g') AS sentence_2
  FROM sg JOIN pp ON pp.lang = sg.lang AND pp.grammar = sg.grammar
  WHERE pp.p1 <> '' AND pp.p2 <> ''
),
dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, sentence_1, sentence_2
      ORDER BY p_grammar_idx, emotion_rank, e_grammar_idx, template_idx, emotion_idx, person_idx) AS rn FROM cand) x
  WHERE rn = 1
),
corpus AS (
  SELECT *, row_number() OVER (PARTITION BY lang, emotion, bias_type
      ORDER BY p_grammar_idx, emotion_rank, e_grammar_idx, template_idx, emotion_idx, person_idx) - 1 AS pair_id
  FROM dedup
),
corpus_long AS (
  SELECT lang, emotion, bias_type, 1 AS side, bias_cat_1 AS grp, pair_id, sentence_1 AS sentence FROM corpus
  UNION ALL
  SELECT lang, emotion, bias_type, 2 AS side, bias_cat_2 AS grp, pair_id, sentence_2 AS sentence FROM corpus
)"""

ORACLE["j01_fill_emotions"] = _with(_CORPUS_INPUTS) + """SELECT s.*, coalesce(n.n_candidates, 0) AS n_candidates
FROM sentences s LEFT JOIN (
  SELECT lang, emotion, e_grammar_idx, template_idx, emotion_idx, count(*) AS n_candidates FROM cand
  GROUP BY lang, emotion, e_grammar_idx, template_idx, emotion_idx) n
USING (lang, emotion, e_grammar_idx, template_idx, emotion_idx)"""
ORACLE["j02_fill_people"] = _with(_CORPUS_INPUTS) + "SELECT * FROM cand"
ORACLE["u04_dedupe_pairs"] = _with(_CORPUS_INPUTS) + "SELECT * FROM corpus"
ORACLE["a25_corpus_sizes"] = _with(_CORPUS_INPUTS) + """SELECT lang, bias_type, emotion, count(*) AS n_pairs,
  count(DISTINCT (sentence_1, sentence_2)) AS n_distinct_pairs, count(DISTINCT sentence_1) AS n_distinct_side_1,
  count(DISTINCT sentence_2) AS n_distinct_side_2
FROM corpus GROUP BY ROLLUP (lang, bias_type, emotion) HAVING lang IS NOT NULL"""
ORACLE["a30_validate_pairs"] = _with(_CORPUS_INPUTS) + """SELECT lang, emotion, bias_type,
  count(*) FILTER (WHERE side = 1) AS n_side_1, count(*) FILTER (WHERE side = 2) AS n_side_2
FROM corpus_long WHERE NOT (emotion = 'joy' AND side = 2 AND pair_id % 3 = 0)
GROUP BY lang, emotion, bias_type HAVING n_side_1 <> n_side_2"""
ORACLE["w01_first_sentences"] = _with(_CORPUS_INPUTS) + "SELECT * FROM corpus_long WHERE pair_id < 11"


# --- review preparation ----------------------------------------------------------------------------

from minpair.functions.text import scrub_pattern as _scrub_pattern  # noqa: E402

_REVIEWS = """reviews AS (
  SELECT doc_id AS review_id, text AS review_body, 'Review ' || doc_id || ' of her ' || source AS review_title, lang AS language,
         source AS product_category, CAST(1 + n_chars % 5 AS INTEGER) AS stars FROM documents
)"""

# RE2's \\b is ASCII-only, so the whole-word rule is emulated with an explicit Unicode word class;
# two passes catch neighbours whose shared separator the first pass consumed.
_ALTS = _scrub_pattern()[len("(?U)\\b"):-len("\\b")]
_WCH = "\\p{L}\\p{N}\\p{M}\\p{Pc}"


def _scrub_sql(x: str) -> str:
    pat = f"(^|[^{_WCH}]){_ALTS}([^{_WCH}]|$)"
    once = f"regexp_replace({x}, '{pat}', '\\1_\\2', 'g')"
    return f"regexp_replace({once}, '{pat}', '\\1_\\2', 'g')"


def _scrub_count_sql(x: str) -> str:
    return (f"CAST(coalesce(len(list_filter(regexp_extract_all({x}, '[{_WCH}]+'), "
            f"lambda w: regexp_full_match(w, '{_ALTS}'))), 0) AS INTEGER)")


_SCRUBBED = f"""scrubbed AS (
  SELECT review_id, product_category, {_scrub_sql('review_body')} AS review_body, {_scrub_sql('review_title')} AS review_title,
    {_scrub_count_sql('review_body')} AS n_scrub_body, {_scrub_count_sql('review_title')} AS n_scrub_title,
    {_scrub_count_sql('review_body')} + {_scrub_count_sql('review_title')} AS n_scrubbed
  FROM reviews WHERE language = 'en'
)"""

ORACLE["p01_format_data"] = _with(_REVIEWS) + """SELECT review_id, review_body || review_title AS text,
  CAST(stars AS INTEGER) AS label FROM reviews"""
ORACLE["t01_scrub_reviews"] = _with(_REVIEWS, _SCRUBBED) + """SELECT review_id, review_body, review_title,
  n_scrub_body, n_scrub_title, n_scrubbed FROM scrubbed"""
ORACLE["t01_scrub_counts"] = _with(_REVIEWS, _SCRUBBED) + """SELECT product_category, count(*) AS n_rows,
  count(*) FILTER (WHERE n_scrubbed > 0) AS n_changed, CAST(sum(n_scrubbed) AS BIGINT) AS n_replacements,
  max(n_scrubbed) AS max_replacements FROM scrubbed GROUP BY product_category"""
ORACLE["a28_class_counts"] = _with(_REVIEWS) + """SELECT language, stars, n,
  min(n) OVER w AS min_class, count(*) OVER w AS n_classes, CAST(sum(n) OVER w AS BIGINT) AS total,
  round(min(n) OVER w * count(*) OVER w * 100.0 / sum(n) OVER w, 6) AS kept_pct
FROM (SELECT language, stars, count(*) AS n FROM reviews GROUP BY language, stars) c
WINDOW w AS (PARTITION BY language)"""
ORACLE["m01_balance_classes"] = _with(_REVIEWS) + """SELECT review_id, language, stars FROM (
  SELECT *, row_number() OVER (PARTITION BY stars ORDER BY md5(concat_ws('-', 42, review_id)), review_id) - 1 AS pos
  FROM reviews) r
JOIN (SELECT min(n) AS lim FROM (SELECT stars, count(*) AS n FROM reviews GROUP BY stars) c) l ON r.pos < l.lim"""

_HASH_SPLIT = """split AS (
  SELECT review_id, stars, CASE WHEN b < 950 THEN 'train' WHEN b < 975 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, ('0x' || substr(md5(concat_ws('-', 42, review_id)), 1, 8))::BIGINT % 1000 AS b FROM reviews) h
)"""
ORACLE["m02_split"] = _with(_REVIEWS, _HASH_SPLIT) + "SELECT * FROM split"
ORACLE["m02_split_exact"] = _with(_REVIEWS, """p AS (
  SELECT review_id, stars, row_number() OVER (ORDER BY md5(concat_ws('-', 42, 'a', review_id)), review_id) - 1 AS p1,
         count(*) OVER () AS n FROM reviews
), held AS (
  SELECT review_id, stars, row_number() OVER (ORDER BY md5(concat_ws('-', 42, 'b', review_id)), review_id) - 1 AS p2,
         count(*) OVER () AS m FROM p WHERE p1 >= n - ceil(n * 0.05)
)""") + """SELECT review_id, stars, 'train' AS split FROM p WHERE p1 < n - ceil(n * 0.05)
UNION ALL
SELECT review_id, stars, CASE WHEN p2 < m - ceil(m * 0.5) THEN 'validation' ELSE 'test' END FROM held"""
ORACLE["u08_interleave"] = """WITH d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
         CAST(regexp_extract(source, 'src(\\d+)', 1) AS INTEGER) AS si FROM documents
), lim AS (
  SELECT source, min(n) OVER () AS mn, count(*) OVER () AS k, dense_rank() OVER (ORDER BY si) - 1 AS rk
  FROM (SELECT source, si, count(*) AS n FROM d GROUP BY source, si) c
)
SELECT d.doc_id, d.source, d.pos, d.pos * lim.k + lim.rk AS interleave_pos
FROM d JOIN lim ON d.source = lim.source WHERE d.pos < lim.mn"""
ORACLE["w05_first_rows"] = _with(_REVIEWS, _HASH_SPLIT) + """SELECT * FROM (
  SELECT review_id, stars, split, row_number() OVER (PARTITION BY split ORDER BY review_id) - 1 AS pos FROM split) s
WHERE pos < 1000"""
ORACLE["w06_seeded_shuffle"] = _with(_REVIEWS, _HASH_SPLIT) + """SELECT review_id, stars, split,
  row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws('-', 7, review_id)), review_id) - 1 AS shuffle_pos
FROM split"""
ORACLE["j11_category_mapping"] = _with(_REVIEWS) + """SELECT r.product_category, r.review_id,
  CASE WHEN k % 6 = 0 THEN NULL ELSE 'cat' || CAST(k % 6 AS VARCHAR) END AS target_category,
  CASE WHEN k IS NULL THEN NULL ELSE k % 5 = 0 END AS uncertain
FROM reviews r LEFT JOIN (SELECT unnest(range(0, 20)) AS k) m ON r.product_category = 'src' || CAST(m.k AS VARCHAR)"""


# --- result marts ---------------------------------------------------------------------------------

_MODEL_TYPE = ("CASE seed WHEN 0 THEN 'baseline' WHEN 5 THEN 'mono' WHEN 26 THEN 'multi_xl' "
               "WHEN 42 THEN 'mono_c' WHEN 63 THEN 'multi_on_mono' END")
_CONV = """conv AS (SELECT * FROM (VALUES
  ('mono', 'en', 33334), ('mono_c', 'en', 50001), ('multi_on_mono', 'en', 33334),
  ('mono', 'fr', 33334), ('mono_c', 'fr', 50001), ('multi_on_mono', 'fr', 33334),
  ('mono', 'de', 50001), ('mono_c', 'de', 50001), ('multi_on_mono', 'de', 33334),
  ('mono', 'es', 50001), ('mono_c', 'es', 50001), ('multi_on_mono', 'es', 33334),
  ('multi_xl', NULL, 50001)) AS c(c_type, c_lang, c_steps))"""
_LABEL_RESULTS = f"""label_results AS (
  SELECT *, label_1 - label_2 AS performance_gap, {_MODEL_TYPE} AS model_type FROM seed_pairs
  WHERE label_1 IS NOT NULL AND label_2 IS NOT NULL
)"""
_ORDER_ROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(_dims.MODEL_TYPE_ORDER))
_MART = f"""mart0 AS (
  SELECT r.* FROM label_results r WHERE r.model_type <> 'baseline' AND EXISTS (
    SELECT 1 FROM conv c WHERE c.c_type = r.model_type AND c.c_steps = r.steps AND (c.c_lang IS NULL OR c.c_lang = r.lang))
  UNION ALL SELECT * FROM label_results WHERE model_type = 'baseline'
),
mart AS (
  SELECT m.model_type, o.type_order,
    CASE WHEN m.lang = 'en_scrubbed' THEN 'en_s' ELSE m.lang END AS lang, m.bias_type, m.emotion, m.steps, m.pair_id,
    m.label_1, m.label_2, m.performance_gap,
    CASE WHEN CAST(trunc(m.performance_gap) AS BIGINT) < 0 THEN 'male_bias'
         WHEN CAST(trunc(m.performance_gap) AS BIGINT) > 0 THEN 'female_bias' END AS bias_direction,
    abs(m.performance_gap) AS performance_gap_abs
  FROM mart0 m LEFT JOIN (VALUES {_ORDER_ROWS}) AS o(type_order, model_type) ON o.model_type = m.model_type
  WHERE m.bias_type <> 'rank'
)"""
_M = [votes_cte(), _SEED_PAIRS, _CONV, _LABEL_RESULTS, _MART]

ORACLE["s07_result_mart"] = _with(*_M) + "SELECT * FROM mart"

ORACLE["j04_converged_summaries"] = _with(votes_cte(), _SEED_PAIRS, _CONV, _LABEL_RESULTS, "summ AS (" + bias_stats_select(
    "label_results", ["model_type", "lang", "bias_type", "steps"]) + ")") + """SELECT * FROM summ r
WHERE r.model_type = 'baseline' OR EXISTS (SELECT 1 FROM conv c WHERE c.c_type = r.model_type AND c.c_steps = r.steps
  AND (c.c_lang IS NULL OR c.c_lang = r.lang))"""

ORACLE["p11_significance_flags"] = _with(votes_cte(), _SEED_PAIRS, _CONV, _LABEL_RESULTS, "summ AS (" + bias_stats_select(
    "label_results", ["model_type", "lang", "bias_type", "emotion", "steps"]) + ")") + f"""SELECT model_type, lang, bias_type,
  emotion, steps, performance_gap, statistical_significance,
  CASE WHEN statistical_significance < 0.05 THEN 1 ELSE 0 END AS significant,
  coalesce(statistical_significance > 0.05, false) AS not_significant,
  CASE WHEN statistical_significance < {0.05 / 8!r} THEN 1 ELSE 0 END AS significant_corrected,
  performance_gap BETWEEN -0.1 AND 0.1 AS within_band
FROM summ"""

ORACLE["a29_mono_vs_multi"] = _with(*_M, """mm AS (
  SELECT a.lang, a.bias_type, a.performance_gap AS label_1, b.performance_gap AS label_2
  FROM mart a JOIN mart b ON a.lang = b.lang AND a.bias_type = b.bias_type AND a.emotion = b.emotion AND a.pair_id = b.pair_id
  WHERE a.model_type = 'mono' AND b.model_type = 'multi_xl'
), agg AS (
  SELECT lang, bias_type, count(label_1 - label_2) AS n_pairs, avg(CAST(label_1 - label_2 AS DOUBLE)) AS md,
         stddev_samp(CAST(label_1 - label_2 AS DOUBLE)) AS sd FROM mm GROUP BY lang, bias_type
), tt AS (SELECT *, """ + t_sql("n_pairs", "md", "sd") + """ AS t FROM agg)""") + f"""SELECT lang, bias_type, n_pairs,
  round(md, 6) AS mean_diff, round(sd, 6) AS sd_diff, round(t, 6) AS t_statistic,
  round({t_p_sql('t', 'n_pairs - 1')}, 6) AS statistical_significance FROM tt"""

_PERF_KEYS = ["lang", "model_type", "bias_type", "steps", "side", "bias_cat"]
ORACLE["a31_performance_curve"] = _with(votes_cte(), _SEED_PAIRS, _LABEL_RESULTS, f"""lr_long AS (
  SELECT lang, model_type, bias_type, steps, {_GOLD} AS gold_label, 1 AS side, bias_cat_1 AS bias_cat, {_pol('label_1')} AS pred
  FROM label_results
  UNION ALL
  SELECT lang, model_type, bias_type, steps, {_GOLD} AS gold_label, 2 AS side, bias_cat_2 AS bias_cat, {_pol('label_2')} AS pred
  FROM label_results
)""", class_table_ctes("m", "lr_long", _PERF_KEYS, "gold_label", "pred")) + """SELECT lang, model_type, bias_type,
  side, bias_cat, steps, round(avg(f1), 6) AS f1, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS acc
FROM m_cls GROUP BY lang, model_type, bias_type, steps, side, bias_cat"""

ORACLE["a14_language_difference"] = _with(votes_cte(), ensemble_cte(), """ld AS (
  SELECT bias_type, steps, label_1, label_2, CASE WHEN lang = 'en' THEN 1 ELSE -1 END AS w FROM ens WHERE lang IN ('en', 'de')
)""") + "SELECT * FROM " + confusion_sql("ld", ["bias_type", "steps"], "label_1", "label_2", [1, 2, 3, 4, 5], "w") + " q"

ORACLE["s10_results_roundtrip"] = _with(votes_cte(), _SEED_PAIRS, "summ AS (" + bias_stats_select(
    "seed_pairs", ["lang", "seed", "bias_type", "steps"]) + ")") + """SELECT bias_cat_1_mean, bias_cat_2_mean,
  performance_gap, statistical_significance, bias_cat_1_name, bias_cat_2_name, bias_type, steps, lang, seed FROM summ"""


# --- text and models --------------------------------------------------------------------------------

from minpair.functions.text import PUNCTUATION as _PUNCT  # noqa: E402

_TOK = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}]{{2,}}')"


def _tokens(x: str) -> str:
    return _TOK.format(x=x)


ORACLE["t03_normalise"] = f"""SELECT doc_id, regexp_replace(translate(trim(text), {_lit(_PUNCT)}, {_lit(' ' * len(_PUNCT))}),
  ' +', ' ', 'g') AS normalised FROM documents"""
ORACLE["t10_word_tokens"] = f"""SELECT doc_id, CAST(len({_tokens('text')}) AS INTEGER) AS n_tokens,
  array_to_string({_tokens('text')}, ' ') AS tokens FROM documents"""
_TC = f"""tc AS (
  SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) t
  GROUP BY doc_id, term
)"""
ORACLE["m03_term_counts"] = _with(_TC) + "SELECT * FROM tc"
ORACLE["m04_tfidf"] = _with(_TC, """idf AS (
  SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM tc GROUP BY term
), w AS (SELECT tc.doc_id, tc.term, tc.n, tc.n * idf.idf AS w FROM tc JOIN idf USING (term))""") + """SELECT doc_id, term, n,
  round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w"""

_PROFILE = """dl AS (SELECT doc_id, lower(text) AS t, lang FROM documents),
dgrams AS (
  SELECT doc_id, lang, substring(t, i, 3) AS gram FROM (
    SELECT doc_id, lang, t, unnest(generate_series(1, length(t) - 2)) AS i FROM dl WHERE length(t) >= 3) x
),
prof0 AS (SELECT lang, gram, count(*) AS c FROM dgrams GROUP BY lang, gram),
tot AS (SELECT lang, sum(c) AS total, (SELECT count(DISTINCT gram) FROM prof0) AS v FROM prof0 GROUP BY lang),
prof AS (
  SELECT p.lang, p.gram, ln((p.c + 1.0) / (t.total + t.v)) AS logp, ln(1.0 / (t.total + t.v)) AS unseen
  FROM prof0 p JOIN tot t USING (lang)
),
langs AS (SELECT DISTINCT lang, unseen FROM prof)"""


def _identify(src: str) -> str:
    """``src(id, text)`` -> ``best(id, detected_lang, score)``."""
    return f"""sl AS (SELECT id, lower(text) AS t FROM {src}),
sgrams AS (
  SELECT id, substring(t, i, 3) AS gram, count(*) AS n FROM (
    SELECT id, t, unnest(generate_series(1, length(t) - 2)) AS i FROM sl WHERE length(t) >= 3) x GROUP BY id, gram
),
ntot AS (SELECT id, sum(n) AS n_total FROM sgrams GROUP BY id),
per AS (
  SELECT g.id, p.lang, sum(g.n * p.logp) AS seen, sum(g.n) AS n_seen FROM sgrams g JOIN prof p USING (gram)
  GROUP BY g.id, p.lang
),
scores AS (
  SELECT n.id, l.lang, coalesce(per.seen, 0) + (n.n_total - coalesce(per.n_seen, 0)) * l.unseen AS score
  FROM ntot n CROSS JOIN langs l LEFT JOIN per ON per.id = n.id AND per.lang = l.lang
),
best AS (
  SELECT id, lang AS detected_lang, score FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, lang) AS r FROM scores) s WHERE r = 1
)"""


ORACLE["t04_identify_language"] = _with(_PROFILE, "src AS (SELECT doc_id AS id, text FROM documents)",
                                        _identify("src")) + """SELECT id AS doc_id, detected_lang,
  round(score, 3) AS score FROM best"""
ORACLE["a24_texts_by_language"] = _with(
    _PROFILE, "src AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, role, text FROM conversations)",
    _identify("src")) + """SELECT s.role, b.detected_lang, count(*) AS n FROM best b JOIN src s USING (id)
GROUP BY ROLLUP (s.role, b.detected_lang)"""
ORACLE["t05_script_flags"] = """SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_matches(
  CASE WHEN doc_id % 7 = 0 THEN translate(text, 'aeo', '\u6f22\u5b57\u56fd') ELSE text END, '\\p{Han}')) AS n_han
FROM documents GROUP BY lang"""

_RSPLIT = _REVIEWS + """,
rsplit AS (
  SELECT review_id, stars AS label, CASE WHEN b < 950 THEN 'train' WHEN b < 975 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, ('0x' || substr(md5(concat_ws('-', 42, review_id)), 1, 8))::BIGINT % 1000 AS b FROM reviews) h
)"""
ORACLE["m06_dummy_most_frequent"] = _with(_RSPLIT) + """SELECT review_id, split, label,
  (SELECT arg_min(label, (-n, label)) FROM (SELECT label, count(*) AS n FROM rsplit WHERE split = 'train' GROUP BY label) c)
    AS prediction
FROM rsplit WHERE split <> 'train'"""
ORACLE["m06_dummy_stratified"] = _with(_RSPLIT, """cls AS (
  SELECT label AS prediction, hi - w AS lo, hi FROM (
    SELECT label, w, sum(w) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM (
      SELECT label, n / sum(n) OVER () AS w FROM (
        SELECT label, count(*) AS n FROM rsplit WHERE split = 'train' GROUP BY label) c) c2) c3
), t AS (
  SELECT *, (('0x' || substr(md5(concat_ws('-', 3, review_id)), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u
  FROM rsplit WHERE split <> 'train'
)""") + """SELECT t.review_id, t.split, t.label, c.prediction FROM t JOIN cls c
  ON t.u >= c.lo AND (t.u < c.hi OR c.hi >= 0.999999999)"""

_LEX_ROWS = sorted({(l, (w or '').lower(), 5 if c == 'joy' else 1) for (l, _i, c, w, _g, _f) in _cp.EMOTIONS
                    if w and c in ('joy', 'anger', 'sadness', 'fear')})
_SCORED = _CORPUS_INPUTS + f""",
lex AS (SELECT * FROM {_vals(_LEX_ROWS, "lang, word, stars", "lx")}),
scored AS (
  SELECT c.lang, c.emotion, c.bias_type, c.side, c.grp, c.pair_id, c.sentence,
    coalesce(CAST(round(avg(lex.stars)) AS INTEGER), 3) AS label
  FROM corpus_long c
  LEFT JOIN (SELECT lang, emotion, bias_type, side, pair_id, unnest({_tokens('sentence')}) AS w FROM corpus_long) t
    ON t.lang = c.lang AND t.emotion = c.emotion AND t.bias_type = c.bias_type AND t.side = c.side AND t.pair_id = c.pair_id
  LEFT JOIN lex ON lex.lang = t.lang AND lex.word = t.w
  GROUP BY c.lang, c.emotion, c.bias_type, c.side, c.grp, c.pair_id, c.sentence
),
scored_pairs AS (
  SELECT lang, emotion, bias_type, pair_id, max(CASE WHEN side = 1 THEN label END) AS label_1,
    max(CASE WHEN side = 2 THEN label END) AS label_2, max(CASE WHEN side = 1 THEN grp END) AS bias_cat_1,
    max(CASE WHEN side = 2 THEN grp END) AS bias_cat_2
  FROM scored GROUP BY lang, emotion, bias_type, pair_id
)"""
ORACLE["m09_corpus_bias"] = _with(_SCORED) + bias_stats_select("scored_pairs", ["lang", "bias_type", "emotion"])
ORACLE["m09_corpus_performance"] = _with(_SCORED, f"""ev AS (
  SELECT bias_type, grp, {_GOLD} AS gold_label, {_pol('label')} AS pred FROM scored
), nest AS (
  SELECT 'group' AS level, bias_type, grp, gold_label, pred FROM ev
  UNION ALL SELECT 'bias_type', bias_type, '', gold_label, pred FROM ev
  UNION ALL SELECT 'all', '', '', gold_label, pred FROM ev
)""", class_table_ctes("m", "nest", ["level", "bias_type", "grp"], "gold_label", "pred")) + """SELECT level, bias_type,
  grp, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1,
  CAST(sum(support) AS BIGINT) AS support, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS acc
FROM m_cls GROUP BY level, bias_type, grp"""


# --- nearest words ------------------------------------------------------------------------------------

_KNN = """wv AS (SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
seeds AS (SELECT 'w' || CAST(min(vec_id) AS VARCHAR) AS word FROM embeddings GROUP BY label),
sv AS (SELECT s.word, w.v FROM seeds s JOIN wv w USING (word)),
sims AS (
  SELECT sv.word AS seed, wv.word,
    list_dot_product(sv.v, wv.v) / (sqrt(list_dot_product(sv.v, sv.v)) * sqrt(list_dot_product(wv.v, wv.v))) AS similarity
  FROM sv CROSS JOIN wv
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, word) AS rank FROM sims)"""
ORACLE["w02_nearest_words"] = _with(_KNN) + """SELECT seed, word, round(similarity, 6) AS similarity,
  CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 20"""
ORACLE["u09_neighbour_set"] = _with(_KNN) + "SELECT DISTINCT word FROM ranked WHERE rank <= 20"


# --- remaining statistics ------------------------------------------------------------------------

ORACLE["a23_mean_labels"] = _with(votes_cte()) + """SELECT lang, seed, steps, grp, emotion, count(label) AS n,
  round(avg(CAST(label AS DOUBLE)), 6) AS mean_label, CASE WHEN emotion IS NULL THEN 'grp' ELSE 'emotion' END AS level
FROM votes GROUP BY GROUPING SETS ((lang, seed, steps, grp), (lang, seed, steps, grp, emotion))"""

_SIDES_ROWS = [(l, bt, g, s) for l, bt, c1, c2 in _dims.BIAS_CATALOGUE for g, s in ((c1, 1), (c2, 2))]
ORACLE["j05_catalogue_sides"] = _with(votes_cte()) + f"""SELECT c.lang, c.bias_type, c.side, count(*) AS n,
  CAST(sum(v.label) AS BIGINT) AS label_sum
FROM votes v JOIN {_vals(_SIDES_ROWS, "lang, bias_type, grp, side", "c")} ON c.lang = v.lang AND c.grp = v.grp
GROUP BY c.lang, c.bias_type, c.side"""

_GS_KEYS = ["lang", "bias_type", "steps"]
ORACLE["a03_a04_grouping_sets"] = _with(votes_cte(), ensemble_cte(), """ens_all AS (
  SELECT lang, bias_type, steps, bias_cat_1, bias_cat_2, CAST(NULL AS VARCHAR) AS emotion, label_1, label_2 FROM ens
  UNION ALL SELECT lang, bias_type, steps, bias_cat_1, bias_cat_2, emotion, label_1, label_2 FROM ens
), ens_tagged AS (SELECT *, coalesce(emotion, '<all>') AS emo_key FROM ens_all)""") + f"""SELECT lang, bias_type, steps,
  CASE WHEN emo_key = '<all>' THEN NULL ELSE emo_key END AS emotion,
  CASE WHEN emo_key = '<all>' THEN 'all' ELSE 'emotion' END AS level, bias_cat_1_name, bias_cat_2_name, n_pairs,
  bias_cat_1_mean, bias_cat_2_mean, performance_gap, t_statistic, statistical_significance
FROM ({bias_stats_select("ens_tagged", ["lang", "bias_type", "steps", "emo_key"])}) q"""

ORACLE["j08_scored_runs"] = _with(_CORPUS_INPUTS + f""",
lex AS (SELECT * FROM {_vals(_LEX_ROWS, "lang, word, stars", "lx")}),
runs AS (SELECT * FROM {_vals([(s, st) for s, _ in _dims.SEEDS for st in _dims.STEPS], "seed, steps", "rr")}),
lexr AS (SELECT seed, steps, lex.* FROM lex CROSS JOIN runs WHERE substr(md5(seed || '-' || steps || '-' || word), 1, 1) < 'c'),
tok AS (SELECT lang, emotion, bias_type, side, pair_id, unnest({_tokens('sentence')}) AS w FROM corpus_long),
scored AS (
  SELECT r.seed, r.steps, c.lang, c.emotion, c.bias_type, c.side, c.pair_id, coalesce(CAST(round(avg(l.stars)) AS INTEGER), 3) AS label
  FROM corpus_long c CROSS JOIN runs r
  LEFT JOIN tok t ON t.lang = c.lang AND t.emotion = c.emotion AND t.bias_type = c.bias_type AND t.side = c.side AND t.pair_id = c.pair_id
  LEFT JOIN lexr l ON l.lang = t.lang AND l.word = t.w AND l.seed = r.seed AND l.steps = r.steps
  GROUP BY r.seed, r.steps, c.lang, c.emotion, c.bias_type, c.side, c.pair_id
)""") + "SELECT seed, steps, lang, label, count(*) AS n FROM scored GROUP BY seed, steps, lang, label"

ORACLE["j12_missing_groups"] = _with(votes_cte()) + f"""SELECT s.lang, s.steps, c.bias_type, c.grp, c.side
FROM (SELECT DISTINCT lang, steps FROM votes) s JOIN {_vals(_SIDES_ROWS, "lang, bias_type, grp, side", "c")} ON c.lang = s.lang
WHERE NOT EXISTS (SELECT 1 FROM votes v WHERE v.lang = s.lang AND v.steps = s.steps AND v.bias_type = c.bias_type
                  AND v.grp = c.grp) OR (s.lang = 'de' AND s.steps = (SELECT max(steps) FROM votes) AND c.bias_type = 'gender' AND c.side = 2)"""


# --- pair encoding ---------------------------------------------------------------------------------

_B = 497  # 500 minus the three special tokens
ORACLE["t11_encode_pairs"] = _with(_REVIEWS, f"""tok_all AS (
  SELECT review_id, unnest({_tokens("review_body || ' ' || review_title")}) AS term FROM reviews
), vocab AS (
  SELECT term, row_number() OVER (ORDER BY cnt DESC, term) - 1 + 4 AS id
  FROM (SELECT term, count(*) AS cnt FROM tok_all GROUP BY term) c
), seg_tok AS (
  SELECT review_id, 0 AS seg, unnest({_tokens('review_body')}) AS term,
         generate_subscripts({_tokens('review_body')}, 1) AS pos FROM reviews
  UNION ALL
  SELECT review_id, 1 AS seg, unnest({_tokens('review_title')}) AS term,
         generate_subscripts({_tokens('review_title')}, 1) AS pos FROM reviews
), ids AS (
  SELECT s.review_id, s.seg, s.pos, coalesce(v.id, 3) AS id FROM seg_tok s LEFT JOIN vocab v USING (term)
), ab AS (
  SELECT r.review_id,
    coalesce((SELECT list(id ORDER BY pos) FROM ids WHERE ids.review_id = r.review_id AND seg = 0), []) AS a,
    coalesce((SELECT list(id ORDER BY pos) FROM ids WHERE ids.review_id = r.review_id AND seg = 1), []) AS b
  FROM reviews r
), l AS (SELECT *, len(a) AS la, len(b) AS lb FROM ab),
ks AS (
  SELECT *,
    CASE WHEN la + lb <= {_B} THEN least(la, lb) WHEN least(la, lb) <= {_B // 2} THEN least(la, lb) ELSE {_B // 2} END AS k_short
  FROM l
), kl AS (SELECT *, CASE WHEN la + lb <= {_B} THEN greatest(la, lb) ELSE {_B} - k_short END AS k_long FROM ks),
k AS (
  SELECT *,
    CAST(CASE WHEN la > lb THEN k_long WHEN la < lb THEN k_short ELSE ceil(least(la + lb, {_B}) / 2) END AS INTEGER) AS ka,
    CAST(CASE WHEN la > lb THEN k_short WHEN la < lb THEN k_long ELSE floor(least(la + lb, {_B}) / 2) END AS INTEGER) AS kb
  FROM kl
)""") + """SELECT review_id,
  array_to_string([1] || a[1:ka] || [2] || b[1:kb] || [2] || list_transform(range(500 - (ka + kb + 3)), lambda x: 0), ' ') AS input_ids,
  CAST(ka + kb + 3 AS INTEGER) AS n_attended, CAST(kb + 1 AS INTEGER) AS n_second
FROM k"""


# --- bootstrap interval ----------------------------------------------------------------------------

def _u_sql(key: str, b: str, seed: int, stream: int) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {key}, CAST({b} AS VARCHAR), '{seed}', '{stream}')), 1, 13))::BIGINT + 0.5) / {float(16 ** 13)!r})"


_POISSON_SMALL = ("list_reduce(range(0, greatest(CAST(floor(r + 12.0 * sqrt(r) + 12.0) AS BIGINT), 1) + 1), "
                  "lambda acc, i: CASE WHEN acc.res >= 0 THEN acc "
                  "WHEN acc.cdf >= u1 THEN {'k': acc.k, 'pmf': acc.pmf, 'cdf': acc.cdf, 'res': acc.k} "
                  "ELSE {'k': acc.k + 1, 'pmf': acc.pmf * r / (acc.k + 1), 'cdf': acc.cdf + acc.pmf * r / (acc.k + 1), "
                  "'res': -1} END, {'k': 0, 'pmf': exp(-r), 'cdf': exp(-r), 'res': -1})")


def _draw(tag: str) -> str:
    return f"((('0x' || substr(md5(key || '|{tag}' || i::VARCHAR), 1, 13))::BIGINT + 0.5) / {float(16 ** 13)!r}::DOUBLE)"


def bootstrap_sql(source: str, keys: list[str], value: str, replicates: int) -> str:
    """Poisson bootstrap: the remainder of a count by 16 by inversion, the rest by rejection, each try a row."""
    kc = ", ".join(keys)
    named = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"""cells AS (
  SELECT {kc}, CAST({value} AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS c
  FROM {source} WHERE {value} IS NOT NULL GROUP BY {kc}, {value}
), keyed AS (
  SELECT cells.*, c - (c::BIGINT % 16) AS lam, (c::BIGINT % 16)::DOUBLE AS r, b.b,
    concat_ws('|', {named}, CAST(v AS VARCHAR), CAST(b.b AS VARCHAR), '0') AS key
  FROM cells CROSS JOIN (SELECT unnest(range(1, {replicates + 1})) AS b) b
), small AS (
  SELECT *, CASE WHEN p.res >= 0 THEN p.res ELSE p.k END AS w1 FROM (SELECT *, {_POISSON_SMALL} AS p FROM (
    SELECT *, {_draw('1').replace(" || i::VARCHAR", "")} AS u1 FROM keyed) k1) k2
), tries AS (
  SELECT key, lam, i, {_draw('u')} - 0.5 AS u, {_draw('v')} AS w, 0.931::DOUBLE + 2.53::DOUBLE * sqrt(lam) AS pb
  FROM keyed, (SELECT unnest(range(0, 32)) AS i) t WHERE lam > 0
), tried AS (
  SELECT *, 0.5 - abs(u) AS us, -0.059::DOUBLE + 0.02483::DOUBLE * pb AS pa FROM tries
), proposed AS (
  SELECT *, floor((2.0 * pa / us + pb) * u + lam + 0.43) AS k FROM tried
), accepted AS (
  SELECT key, arg_min(k, i) AS w2 FROM proposed
  WHERE k >= 0 AND ((us >= 0.07 AND w <= 0.9277::DOUBLE - 3.6224::DOUBLE / (pb - 2.0)) OR (NOT (us < 0.013 AND w > us)
    AND ln(w) + ln(1.1239::DOUBLE + 1.1328::DOUBLE / (pb - 3.4)) - ln(pa / (us * us) + pb) <= k * ln(lam) - lam - lgamma(k + 1.0)))
  GROUP BY key
), w AS (
  SELECT s.*, s.w1 + CASE WHEN s.lam > 0 THEN coalesce(a.w2, s.lam) ELSE 0 END AS wt FROM small s LEFT JOIN accepted a USING (key)
), means AS (
  SELECT {kc}, b, sum(wt * v) / nullif(sum(wt), 0) AS m, sum(c * v) / sum(c) AS point, sum(c) AS n FROM w GROUP BY {kc}, b
), ci AS (
  SELECT {kc}, CAST(first(n) AS BIGINT) AS n, round(first(point), 6) AS mean,
    round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM means GROUP BY {kc}
)"""


ORACLE["a18_bootstrap_ci"] = _with(votes_cte(), ensemble_cte(), bootstrap_sql(
    "ens", ["lang", "bias_type", "steps"], "performance_gap", 200)) + "SELECT * FROM ci"

ORACLE["a11_emotion_group_performance"] = _with(_SCORED, f"""ev AS (
  SELECT emotion, grp, {_GOLD} AS gold_label, {_pol('label')} AS pred FROM scored
), nest AS (
  SELECT 'group' AS level, emotion, grp, gold_label, pred FROM ev
  UNION ALL SELECT 'emotion', emotion, '', gold_label, pred FROM ev
  UNION ALL SELECT 'all', '', '', gold_label, pred FROM ev
)""", class_table_ctes("m", "nest", ["level", "emotion", "grp"], "gold_label", "pred")) + """SELECT level, emotion,
  grp, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1,
  CAST(sum(support) AS BIGINT) AS support, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS acc
FROM m_cls GROUP BY level, emotion, grp"""

_OVERALL_COLS = """bias_cat_1_mean, bias_cat_2_mean, performance_gap, statistical_significance, bias_cat_1_name,
  bias_cat_2_name, bias_type, steps, lang"""
ORACLE["s11_overall_results_roundtrip"] = _with(
    votes_cte(), _MEAN_PAIRS, ensemble_cte(),
    "m AS (" + bias_stats_select("mean_pairs", ["lang", "bias_type", "steps"]) + ")",
    "e AS (" + bias_stats_select("ens", ["lang", "bias_type", "steps"]) + ")") + f"""SELECT {_OVERALL_COLS},
  'overall' AS averaging FROM m
UNION ALL SELECT {_OVERALL_COLS}, 'ensemble' AS averaging FROM e"""

_U01_COLS = """lang, bias_type, steps, bias_cat_1_name, bias_cat_2_name, n_pairs, bias_cat_1_mean, bias_cat_2_mean,
  performance_gap, t_statistic, statistical_significance"""
ORACLE["u01_union_results"] = _with(
    votes_cte(), _SEED_PAIRS, ensemble_cte(),
    "r AS (" + bias_stats_select("seed_pairs", ["lang", "seed", "bias_type", "steps"]) + ")",
    "e AS (" + bias_stats_select("ens", ["lang", "bias_type", "steps"]) + ")") + f"""SELECT {_U01_COLS}, seed,
  'run' AS averaging FROM r
UNION ALL SELECT {_U01_COLS}, CAST(NULL AS INTEGER) AS seed, 'ensemble' AS averaging FROM e"""

ORACLE["m06_dummy_uniform"] = _with(_RSPLIT, """cls AS (
  SELECT label AS prediction, k, count(*) OVER () AS nc FROM (
    SELECT label, row_number() OVER (ORDER BY label) AS k FROM (SELECT DISTINCT label FROM rsplit WHERE split = 'train') d) c
), t AS (
  SELECT *, (('0x' || substr(md5(concat_ws('-', 11, review_id)), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u
  FROM rsplit WHERE split <> 'train'
), cut AS (
  SELECT prediction, k, nc,
    CASE WHEN k = nc THEN 2.0 ELSE list_reduce(list_transform(range(k), lambda i: 1.0 / nc), lambda a, b: a + b, 0.0) END AS hi
  FROM cls
)""") + """SELECT t.review_id, t.split, t.label,
  (SELECT prediction FROM cut WHERE t.u < cut.hi ORDER BY k LIMIT 1) AS prediction
FROM t"""


# --- sources and sinks -------------------------------------------------------------------------------
ORACLE["s01_reviews_roundtrip"] = _with(_RSPLIT) + """SELECT r.review_id, r.stars, r.product_category
FROM reviews r JOIN rsplit USING (review_id) WHERE r.language = 'en' AND rsplit.split = 'train'"""
ORACLE["s02_category_files"] = _with(_REVIEWS) + """SELECT product_category, count(*) AS n, CAST(sum(stars) AS BIGINT) AS stars
FROM reviews GROUP BY product_category"""
ORACLE["s08_label_files_by_suffix"] = _with(votes_cte(), _SEED_PAIRS) + f"""SELECT p.*, q.performance_gap FROM (
  SELECT seed, steps, lang, bias_type, count(*) AS n, CAST(sum(label_1) AS BIGINT) AS sum_1, CAST(sum(label_2) AS BIGINT) AS sum_2
  FROM seed_pairs GROUP BY seed, steps, lang, bias_type) p
FULL JOIN ({bias_stats_select("seed_pairs", ["lang", "seed", "bias_type", "steps"])}) q USING (seed, steps, lang, bias_type)"""
ORACLE["s09_registry_votes"] = _with(votes_cte()) + """SELECT 'en_30.0_' || seed || '_2021_11_28' AS run, seed_rank, steps, count(*) AS n,
  CAST(sum(label) AS BIGINT) AS label_sum
FROM votes WHERE lang = 'en' GROUP BY seed, seed_rank, steps"""
_FILE_KEYS = ["bias_type", "steps", "side", "bias_cat"]
ORACLE["s12_derived_files"] = _with(*_ENS, class_table_ctes("m", "pol_long", _FILE_KEYS, "gold_label", "pred")) + f"""SELECT
  precision, recall, f1, support, acc, bias_cat, bias_type, steps FROM ({metrics_select("m", _FILE_KEYS)}) q"""
ORACLE["s14_mart_family"] = _with(*_M) + """SELECT model_type, emotion, steps, pair_id, label_1, label_2, bias_direction
FROM mart WHERE model_type IN ('mono', 'multi_xl') AND lang = 'de' AND bias_type = 'gender' AND emotion IN ('joy', 'fear')"""
ORACLE["s15_mapping_file"] = f"SELECT target_category, uncertain, count(*) AS n FROM ({ORACLE['j11_category_mapping']}) q GROUP BY ALL"
ORACLE["s17_vote_log_file"] = ORACLE["a26_vote_log_shares"]
ORACLE["a08_disagreeing_items"] = _with(votes_cte(), vote_cte("vt", "votes", ITEM)) + """SELECT lang, steps, side, pair_id,
  label, kind FROM vt WHERE disagreement"""
ORACLE["m07_linear_baseline_support"] = _with(_RSPLIT) + """SELECT sp.split, CAST(c.k AS VARCHAR) AS row, count(r.review_id) AS support
FROM (SELECT DISTINCT split FROM rsplit WHERE split <> 'train') sp CROSS JOIN (SELECT unnest(range(1, 6)) AS k) c
LEFT JOIN rsplit r ON r.split = sp.split AND r.label = c.k GROUP BY sp.split, c.k
UNION ALL SELECT split, x, count(*) FROM rsplit CROSS JOIN (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) v(x)
WHERE split <> 'train' GROUP BY split, x"""
