"""Oracle SQL of ``reports_more`` and of the trained baseline."""

from __future__ import annotations

from minpair.operators.linear import FEATURE, IDF_UNIT, UNIT, step
from minpair.plans.oracle import _CONV, _CORPUS_INPUTS, _GOLD, _REVIEWS, _SEED_PAIRS, ORACLE, _identify, _pol, _PROFILE, _tokens, _with, bootstrap_sql
from minpair.plans.reports import ROUNDS
from minpair.plans import corpus_parts as _cp
from minpair.plans.sqlkit import bias_stats_select, class_table_ctes, metrics_select, report_select, values, votes_cte

# --- trained baseline: every round spelled out ----------------------------------------------------

_K = range(5)
_REG = 0.01


def _chars(x: str) -> str:
    return f"string_split(regexp_replace(lower({x}), '[ \\t\\n\\x0B\\f\\r]{{2,}}', ' ', 'g'), '')"


def _features(name: str, source: str, keys: str, tokens: str, idf: str | None = None, bias_row: bool = True) -> str:
    """``{name}_x(keys, term, x)`` of ``source(keys, text)``."""
    join, w = (f"JOIN {idf} USING (term)", "n::DOUBLE * idf") if idf else ("", "n::DOUBLE")
    own = f" UNION ALL SELECT {keys}, '', {FEATURE} FROM {source}" if bias_row else ""
    return f"""{name}_tc AS MATERIALIZED (
  SELECT {keys}, term, count(*) AS n FROM (SELECT {keys}, unnest({tokens}) AS term FROM {source}) t GROUP BY {keys}, term
), {name}_x AS MATERIALIZED (
  SELECT {keys}, term, x FROM (SELECT {keys}, term, floor({float(FEATURE)}::DOUBLE * w / sqrt(sum(w * w) OVER (PARTITION BY {keys})))::BIGINT AS x
    FROM (SELECT {keys}, term, {w} AS w FROM {name}_tc {join}) f) q WHERE x > 0{own}
)"""


def _train(idf: bool, tokens: str) -> str:
    """CTEs ``train``, ``held`` and the coefficients ``model(term, w0, ...)`` after all rounds."""
    parts = [_REVIEWS, """formed AS (
  SELECT review_id, stars AS label, review_body || review_title AS text,
    CASE WHEN b < 950 THEN 'train' WHEN b < 975 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, ('0x' || substr(md5(concat_ws('-', 42, review_id)), 1, 8))::BIGINT % 1000 AS b FROM reviews) h
), train AS (SELECT review_id, label, text FROM formed WHERE split = 'train'),
held AS (SELECT review_id, split, label, text FROM formed WHERE split <> 'train'),
size AS (SELECT count(*) AS docs FROM train)"""]
    if idf:
        parts.append(f"""dfq AS MATERIALIZED (
  SELECT term, floor((ln((1.0::DOUBLE + (SELECT docs FROM size)) / (1.0::DOUBLE + count(*))) + 1.0) * {IDF_UNIT} + 0.5)::BIGINT AS idf
  FROM (SELECT DISTINCT review_id, unnest({tokens}) AS term FROM train) t GROUP BY term)""")
    parts.append(_features("tr", "train", "review_id", tokens, "dfq" if idf else None))
    signs = ", ".join(f"CASE WHEN label = {c + 1} THEN 1 ELSE -1 END AS y{c}" for c in _K)
    parts.append(f"y AS MATERIALIZED (SELECT review_id, {signs} FROM train)")
    g = ", ".join(f"sum(x * y{c}) AS g{c}" for c in _K)
    for at in range(1, ROUNDS + 1):
        rate = f"({float(UNIT)}::DOUBLE / ({step(_REG, at)!r}::DOUBLE * (SELECT docs FROM size)))"
        keep = f"{(at - 1) / at!r}::DOUBLE"
        if at == 1:
            inside, old = "y", "(SELECT term, " + ", ".join(f"0 AS w{c}" for c in _K) + ", " + ", ".join(f"g{c}" for c in _K) + " FROM grad1)"
        else:
            sums = ", ".join(f"sum(x * w{c}) AS s{c}" for c in _K)
            cut = ", ".join(f"CASE WHEN y{c} * s{c} < {FEATURE * UNIT} THEN y{c} ELSE 0 END AS y{c}" for c in _K)
            parts.append(f"""in{at} AS MATERIALIZED (
  SELECT review_id, {cut} FROM y JOIN (SELECT review_id, {sums} FROM tr_x JOIN m{at - 1} USING (term) GROUP BY review_id) s USING (review_id))""")
            inside, old = f"in{at}", f"(SELECT * FROM m{at - 1} JOIN grad{at} USING (term))"
        parts.append(f"grad{at} AS MATERIALIZED (SELECT term, {g} FROM tr_x JOIN {inside} USING (review_id) GROUP BY term)")
        new = ", ".join(f"floor(w{c}::DOUBLE * {keep} + g{c}::DOUBLE * {rate} + 0.5)::BIGINT AS w{c}" for c in _K)
        parts.append(f"m{at} AS MATERIALIZED (SELECT term, {new} FROM {old} o)")
    parts.append(f"model AS (SELECT * FROM m{ROUNDS})")
    return ",\n".join(parts)


def _predict(name: str, source: str, keys: str, tokens: str, idf: str | None = None) -> str:
    """``{name}(keys, scores, pred_class)``."""
    sums = ", ".join(f"coalesce(sum(x * w{c}), 0)::BIGINT" for c in _K)
    return _features(f"{name}f", source, keys, tokens, idf) + f""", {name}_s AS (
  SELECT {keys}, [{sums}] AS scores FROM {name}f_x JOIN model USING (term) GROUP BY {keys}
), {name} AS (SELECT *, (list_position(scores, list_max(scores)) - 1)::INTEGER AS pred_class FROM {name}_s)"""


_WORDS = _tokens("text")
_HELD = "judged AS (SELECT h.review_id, h.split, h.label, p.scores, p.pred_class, p.pred_class + 1 AS pred FROM held h JOIN pr p USING (review_id))"
_WORD_MODEL = _train(False, _WORDS)
_CHAR_MODEL = _train(True, _chars("text"))

ORACLE["m05_linear_coefficients"] = _with(_WORD_MODEL) + " UNION ALL ".join(f"SELECT {c} AS class_id, term, w{c} AS weight FROM model" for c in _K)
ORACLE["m07_linear_baseline_report"] = _with(_WORD_MODEL, _predict("pr", "held", "review_id", _WORDS), _HELD, class_table_ctes(
    "m", "judged", ["split"], "label", "pred", [1, 2, 3, 4, 5])) + report_select("m", ["split"])
ORACLE["m07_linear_chars_report"] = _with(_CHAR_MODEL, _predict("pr", "held", "review_id", _chars("text"), "dfq"), _HELD, class_table_ctes(
    "m", "judged", ["split"], "label", "pred", [1, 2, 3, 4, 5])) + report_select("m", ["split"])
ORACLE["p06_class_scores"] = _with(_WORD_MODEL, _predict("pr", "held", "review_id", _WORDS), _HELD) + """SELECT review_id, split, pred_class,
  pred AS pred_stars, array_to_string(scores, ',') AS scores FROM judged"""

_ITEM = "lang, emotion, bias_type, side, pair_id"
_TRAINED = (_CORPUS_INPUTS, _WORD_MODEL, f"sent_rows AS (SELECT {_ITEM}, sentence AS text FROM corpus_long)",
            _predict("pr", "sent_rows", _ITEM, _WORDS), f"""scored AS (
  SELECT c.*, p.pred_class + 1 AS label FROM corpus_long c JOIN pr p USING ({_ITEM}))""")
ORACLE["m08_trained_labels"] = _with(*_TRAINED) + f"SELECT {_ITEM}, label FROM scored"
ORACLE["m09_trained_bias"] = _with(*_TRAINED, """scored_pairs AS (
  SELECT lang, emotion, bias_type, pair_id, max(CASE WHEN side = 1 THEN label END) AS label_1,
    max(CASE WHEN side = 2 THEN label END) AS label_2, max(CASE WHEN side = 1 THEN grp END) AS bias_cat_1,
    max(CASE WHEN side = 2 THEN grp END) AS bias_cat_2
  FROM scored GROUP BY lang, emotion, bias_type, pair_id)""") + bias_stats_select("scored_pairs", ["lang", "bias_type", "emotion"])
ORACLE["m09_trained_performance"] = _with(*_TRAINED, f"""ev AS (
  SELECT bias_type, grp, {_GOLD} AS gold_label, {_pol('label')} AS pred FROM scored
), nest AS (
  SELECT 'group' AS level, bias_type, grp, gold_label, pred FROM ev
  UNION ALL SELECT 'bias_type', bias_type, '', gold_label, pred FROM ev
  UNION ALL SELECT 'all', '', '', gold_label, pred FROM ev
)""", class_table_ctes("m", "nest", ["level", "bias_type", "grp"], "gold_label", "pred")) + """SELECT level, bias_type,
  grp, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1,
  CAST(sum(support) AS BIGINT) AS support, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS acc
FROM m_cls GROUP BY level, bias_type, grp"""


# --- distributions of continuous values, large counts -----------------------------------------------

_EVENTS = "ev AS (SELECT event_type, CAST(user_id % 2 AS INTEGER) AS half, value FROM events)"
_STEPS = """vals AS (SELECT DISTINCT g, value FROM twice), f AS (
  SELECT v.g, v.value, lead(v.value) OVER (PARTITION BY v.g ORDER BY v.value) - v.value AS width,
    (SELECT count(*) FROM twice b WHERE b.g = v.g AND b.half = 0 AND b.value <= v.value)
      / (SELECT count(*) FROM twice b WHERE b.g = v.g AND b.half = 0)::DOUBLE AS fa,
    (SELECT count(*) FROM twice b WHERE b.g = v.g AND b.half = 1 AND b.value <= v.value)
      / (SELECT count(*) FROM twice b WHERE b.g = v.g AND b.half = 1)::DOUBLE AS fb FROM vals v)"""
ORACLE["a17_wasserstein_events"] = _with(_EVENTS, """twice AS (
  SELECT event_type AS g, half, value FROM ev UNION ALL SELECT '<all>', half, value FROM ev)""", _STEPS) + """SELECT
  nullif(g, '<all>') AS event_type, round(sum(abs(fa - fb) * width), 6) AS wasserstein FROM f GROUP BY g"""
ORACLE["a19_five_numbers_events"] = _with(_EVENTS, """q AS (
  SELECT event_type, half, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
  FROM ev GROUP BY event_type, half)""") + """SELECT event_type, half, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  count(*) AS n, min(value) AS min, max(value) AS max, min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
  max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS whisker_high
FROM ev JOIN q USING (event_type, half) GROUP BY event_type, half, q.q1, q.median, q.q3"""
ORACLE["a18_bootstrap_large_counts"] = _with(votes_cte(), bootstrap_sql("votes", ["steps"], "label", 100)) + "SELECT * FROM ci"


# --- sources and sinks on real files ----------------------------------------------------------------

ORACLE["s02_skipped_files"] = """SELECT source AS category, 'read' AS state, 0 AS files_unread, count(*) AS n_rows FROM documents
WHERE source IS NOT NULL GROUP BY source
UNION ALL VALUES ('broken', 'unread', 1, 0), ('absent', 'missing', 0, 0)"""

ORACLE["s03_sheets"] = _with(_CORPUS_INPUTS) + f"""SELECT 'people' AS sheet, lang, true AS header_ok, count(*) AS n_rows,
  count(*) FILTER (WHERE lang = 'es' AND person_idx % 50 = 0) AS n_rejected,
  count(*) FILTER (WHERE NOT (lang = 'es' AND person_idx % 50 = 0)) AS n_last FROM people GROUP BY lang
UNION ALL SELECT 'people', 'pt', false, NULL, NULL, NULL
UNION ALL SELECT 'templates', lang, true, count(*), 0, count(template) FROM {values(_cp.TEMPLATES, "lang, idx, template", "t")} GROUP BY lang
UNION ALL SELECT 'emotions', lang, true, count(*), 0, count(f) FROM {values(_cp.EMOTIONS, "lang, idx, c, w, g, f", "e")} GROUP BY lang"""

_RUN = ["lang", "seed", "bias_type", "steps"]
_SIDE = [*_RUN, "side", "bias_cat"]


def _sides(name: str, where: str) -> str:
    return f"""{name} AS (SELECT lang, seed, bias_type, steps, {_GOLD} AS gold_label, 1 AS side, bias_cat_1 AS bias_cat, {_pol('label_1')} AS pred
  FROM seed_pairs {where} UNION ALL SELECT lang, seed, bias_type, steps, {_GOLD}, 2, bias_cat_2, {_pol('label_2')} FROM seed_pairs {where})"""


_GAP = "sum(label_1 - label_2)::DOUBLE"
_KINDS = {
    "summary": f"SELECT lang, seed, count(*) AS n, sum(statistical_significance) AS total FROM ({bias_stats_select('seed_pairs', _RUN)}) q",
    "summary_emotion": "SELECT lang, seed, count(*) AS n, sum(statistical_significance) AS total FROM ("
                       f"{bias_stats_select('seed_pairs', [*_RUN, 'emotion'])}) q",
    "labels": f"SELECT lang, seed, count(*) AS n, {_GAP} AS total FROM seed_pairs",
    "labels_emotion": f"SELECT lang, seed, count(*) AS n, {_GAP} AS total FROM seed_pairs",
    "polarity": f"SELECT lang, seed, count(*) AS n, sum(CASE {_GOLD} WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END)::DOUBLE "
                "AS total FROM seed_pairs",
    "performance": f"SELECT lang, seed, count(*) AS n, sum(acc) AS total FROM ({metrics_select('a', _SIDE)}) q",
    "performance_binary": f"SELECT lang, seed, count(*) AS n, sum(f1) AS total FROM ({metrics_select('b', _SIDE)}) q",
    "convergence": f"SELECT q.lang, seed, count(*) AS n, sum(bias_cat_1_mean) AS total FROM ({bias_stats_select('seed_pairs', _RUN)}) q "
                   "JOIN conv ON c_type = 'mono' AND c_lang = q.lang AND c_steps = q.steps",
}
ORACLE["s10_output_set"] = _with(votes_cte(), _SEED_PAIRS, _CONV, _sides("all_sides", ""), _sides("marked", f"WHERE {_GOLD} <> 'neutral'"),
                                 class_table_ctes("a", "all_sides", _SIDE, "gold_label", "pred"),
                                 class_table_ctes("b", "marked", _SIDE, "gold_label", "pred")) + " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, lang, seed, n, round(total, 4) AS total, CAST(sum(n) OVER () AS BIGINT) AS n_written FROM ({sql} GROUP BY ALL) k"
    for kind, sql in _KINDS.items())


# --- text and labels --------------------------------------------------------------------------------

ORACLE["t10_char_tokens"] = f"""SELECT doc_id, len({_chars('text')})::INTEGER AS n_tokens, md5(array_to_string({_chars('text')}, '|')) AS digest
FROM documents"""
_HAN = """han AS (SELECT doc_id, lang, CASE doc_id % 11 WHEN 0 THEN translate(text, 'ao', '\u6f22\u5b57')
  WHEN 1 THEN translate(text, 'ao', '\u6c49\u5b57') WHEN 2 THEN translate(text, 'ao', '\u570b\u56fd')
  WHEN 3 THEN translate(text, 'ao', '\u5b57\u4e2d') ELSE text END AS text FROM documents),
zh AS (SELECT *, length(regexp_replace(text, '[^\u6c49\u56fd]', '', 'g')) AS s, length(regexp_replace(text, '[^\u6f22\u570b]', '', 'g')) AS t,
  regexp_matches(text, '\\p{Han}') AS h FROM han),
kinds AS (SELECT doc_id, lang, CASE WHEN h THEN s END AS n_simplified, CASE WHEN h THEN t END AS n_traditional,
  CASE WHEN NOT h THEN NULL WHEN s > 0 AND t > 0 THEN 'mixed' WHEN s > 0 THEN 'simplified' WHEN t > 0 THEN 'traditional' ELSE 'unknown' END AS zh_variant
  FROM zh)"""
ORACLE["t05_chinese_variant"] = _with(_HAN) + "SELECT doc_id, n_simplified, n_traditional, zh_variant FROM kinds"
ORACLE["a24_texts_by_variant"] = _with(_HAN, _PROFILE, "src AS (SELECT doc_id AS id, text FROM han)", _identify("src"), """keys AS (
  SELECT k.lang, b.detected_lang FROM kinds k JOIN best b ON b.id = k.doc_id
  UNION ALL SELECT lang, CASE WHEN zh_variant = 'simplified' THEN 'zh_cn' ELSE 'zh_tr' END FROM kinds WHERE zh_variant IS NOT NULL
)""") + "SELECT lang, detected_lang, count(*) AS n FROM keys GROUP BY ROLLUP (lang, detected_lang)"
ORACLE["p18_effective_lang"] = _with(votes_cte()) + """SELECT CASE WHEN seed = 0 THEN 'multi' WHEN seed = 63 AND lang = 'en' THEN 'en_scrubbed'
  ELSE lang END AS model_lang, CASE WHEN seed = 63 AND lang = 'en' THEN 'en_s' ELSE lang END AS data_lang, count(*) AS n, CAST(sum(label) AS BIGINT) AS label_sum
FROM votes GROUP BY ALL"""
ORACLE["f05_substring_filter"] = _with(votes_cte()) + "SELECT bias_type, lang, count(*) AS n FROM votes WHERE contains(bias_type, 'ra') GROUP BY ALL"
