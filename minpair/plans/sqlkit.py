"""ANSI/DuckDB SQL building blocks for the oracle queries.

Each registered Spark report has an independent SQL formulation over the same parquet tables; the
driver runs both and compares. The fragments here are shared CTEs (derived views) and scalar
formulas; they are written from the operator definitions, not generated from the Spark plans.
"""

from __future__ import annotations

from minpair.plans import dims


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def _values(rows, cols: str, alias: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({cols})"


values = _values


def emotion_case(doc: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(dims.EMOTION_OF_DOC))
    return f"CASE {doc} % {len(dims.EMOTION_OF_DOC)} {whens} END"


def group_case(bias_type: str, side: str) -> str:
    parts = " ".join(
        f"WHEN {bias_type} = '{bt}' THEN CASE WHEN {side} = 1 THEN '{g1}' ELSE '{g2}' END"
        for bt, (g1, g2) in dims.BIAS_GROUPS.items())
    return f"CASE {parts} ELSE {bias_type} || '_' || {side} END"


def votes_cte() -> str:
    """``votes`` view of SURVEY 7.3 (lang, seed, seed_rank, steps, emotion, bias_type, grp, side,
    pair_id, label)."""
    seeds = _values(dims.SEEDS, "seed, seed_rank", "s")
    steps = _values([(s,) for s in dims.STEPS], "steps", "st")
    sides = _values([(1,), (2,)], "side", "sd")
    return f"""votes_raw AS (
  SELECT d.lang, s.seed, s.seed_rank, st.steps,
         {emotion_case('d.doc_id')} AS emotion,
         CASE WHEN d.doc_id % 41 = 40 THEN 'rank' WHEN d.doc_id % 2 = 0 THEN 'gender' ELSE 'race' END AS bias_type,
         sd.side, d.doc_id AS pair_id,
         CAST(1 + (((d.doc_id + 1) * (s.seed + 3) * (7919 * sd.side + 13 + st.steps)) % 10007) % 5 AS INTEGER) AS label
  FROM documents d CROSS JOIN {seeds} CROSS JOIN {steps} CROSS JOIN {sides}
  WHERE NOT (s.seed = 42 AND d.doc_id % 53 = 7)
),
votes AS (
  SELECT lang, seed, seed_rank, steps, emotion, bias_type, {group_case('bias_type', 'side')} AS grp,
         side, pair_id, label FROM votes_raw
)"""


def vote_cte(name: str, source: str, keys: list[str], tie: str = "compat") -> str:
    """Majority vote per item (rules of ``minpair.functions.vote``) as plain SQL."""
    k = ", ".join(keys)
    using = ", ".join(keys)
    if tie == "compat":
        mid = "CAST(ceil(s.n / 2.0) AS BIGINT) + 1"
    else:
        mid = "(s.n - 1) // 2 + 1"
    return f"""{name}_cnt AS (
  SELECT {k}, label, count(*) AS c, min(seed_rank) AS first_rank FROM {source} GROUP BY {k}, label
),
{name}_stat AS (
  SELECT {k}, CAST(sum(c) AS BIGINT) AS n, count(*) AS nd, max(c) AS top FROM {name}_cnt GROUP BY {k}
),
{name}_rank AS (
  SELECT {k}, label, row_number() OVER (PARTITION BY {k} ORDER BY c DESC, first_rank) AS r FROM {name}_cnt
),
{name}_sorted AS (
  SELECT {k}, label, row_number() OVER (PARTITION BY {k} ORDER BY label) AS pos FROM {source}
),
{name} AS (
  SELECT {", ".join("s." + c for c in keys)},
    CAST(CASE WHEN s.top > s.n // 2 THEN w.label WHEN s.nd = s.n THEN m.label ELSE w.label END AS INTEGER) AS label,
    NOT (s.top > s.n // 2) AS disagreement,
    CASE WHEN s.top > s.n // 2 THEN 'agreement' WHEN s.nd = s.n THEN 'no_winner'
         WHEN s.nd = s.n - 1 THEN 'one_winner' ELSE 'tie' END AS kind,
    CAST(CASE WHEN NOT (s.top > s.n // 2) AND s.nd <> s.n AND s.nd <> s.n - 1 THEN r2.label END AS INTEGER) AS runner_up,
    CAST(s.n AS INTEGER) AS n_votes
  FROM {name}_stat s
  JOIN (SELECT * FROM {name}_rank WHERE r = 1) w USING ({using})
  LEFT JOIN (SELECT * FROM {name}_rank WHERE r = 2) r2 USING ({using})
  LEFT JOIN {name}_sorted m ON {" AND ".join(f"m.{c} = s.{c}" for c in keys)} AND m.pos = {mid}
)"""


def ensemble_cte(name: str = "ens", tie: str = "compat") -> str:
    """Ensemble pairs: vote per side, aligned by pair (requires ``votes``)."""
    keys = ["lang", "steps", "bias_type", "emotion", "side", "pair_id"]
    pk = "lang, steps, bias_type, emotion, pair_id"
    return vote_cte(f"{name}_vote", "votes", keys, tie) + f""",
{name}_grp AS (
  SELECT {pk}, max(CASE WHEN side = 1 THEN grp END) AS bias_cat_1, max(CASE WHEN side = 2 THEN grp END) AS bias_cat_2
  FROM votes GROUP BY {pk}
),
{name} AS (
  SELECT v.lang, v.steps, v.bias_type, v.emotion, v.pair_id, g.bias_cat_1, g.bias_cat_2,
    max(CASE WHEN v.side = 1 THEN v.label END) AS label_1,
    max(CASE WHEN v.side = 2 THEN v.label END) AS label_2,
    max(CASE WHEN v.side = 1 THEN v.label END) - max(CASE WHEN v.side = 2 THEN v.label END) AS performance_gap,
    bool_or(CASE WHEN v.side = 1 THEN v.disagreement END) AS disagreement_1,
    bool_or(CASE WHEN v.side = 2 THEN v.disagreement END) AS disagreement_2,
    max(CASE WHEN v.side = 1 THEN v.kind END) AS kind_1,
    max(CASE WHEN v.side = 2 THEN v.kind END) AS kind_2,
    max(CASE WHEN v.side = 1 THEN v.runner_up END) AS runner_up_1,
    max(CASE WHEN v.side = 2 THEN v.runner_up END) AS runner_up_2
  FROM {name}_vote v JOIN {name}_grp g USING ({pk})
  GROUP BY v.lang, v.steps, v.bias_type, v.emotion, v.pair_id, g.bias_cat_1, g.bias_cat_2
  HAVING max(CASE WHEN v.side = 1 THEN v.n_votes END) = {len(dims.SEEDS)}
     AND max(CASE WHEN v.side = 2 THEN v.n_votes END) = {len(dims.SEEDS)}
)"""


def r6(expr: str) -> str:
    return f"round({expr}, 6)"


# --- Student-t p-value (Simpson's rule over the angle, independent of the engine's method) ----------

def t_p_sql(t: str, dof: str) -> str:
    """Two-sided p of Student's t: one less the integral of cos^(v-1) from 0 to atan(|t| / sqrt(v)),
    normalised; the integrand is nil beyond 12 / sqrt(v) for large v."""
    v = f"CAST({dof} AS DOUBLE)"
    top = f"least(atan(abs({t}) / sqrt({v})), 12.0 / sqrt({v}) + 1.6 * CAST({v} < 200 AS INTEGER))"
    terms = (f"list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
             f"* pow(greatest(cos({top} * i / 2000.0), 0.0), {v} - 1.0)))")
    front = f"2.0 * exp(lgamma(({v} + 1.0) / 2.0) - lgamma({v} / 2.0)) / sqrt(pi())"
    return (f"(CASE WHEN ({t}) IS NULL OR isnan({t}) OR {v} <= 0 THEN NULL WHEN isinf({t}) THEN 0.0 "
            f"ELSE least(1.0, greatest(0.0, 1.0 - {front} * {top} / 6000.0 * {terms})) END)")


def t_sql(n: str, mean: str, sd: str) -> str:
    return (f"(CASE WHEN {n} < 2 OR {sd} IS NULL THEN NULL "
            f"WHEN {sd} = 0 THEN CASE WHEN {mean} = 0 THEN NULL WHEN {mean} > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END "
            f"ELSE {mean} / ({sd} / sqrt({n})) END)")


def bias_stats_select(source: str, keys: list[str], where: str = "") -> str:
    """Bias statistics per ``keys`` over an aligned-pair relation with label_1/label_2."""
    k = ", ".join(keys)
    inner = f"""SELECT {k}, bias_cat_1 AS bias_cat_1_name, bias_cat_2 AS bias_cat_2_name,
    count(label_1 - label_2) AS n_pairs,
    avg(CAST(label_1 AS DOUBLE)) AS m1, avg(CAST(label_2 AS DOUBLE)) AS m2,
    avg(CAST(label_1 AS DOUBLE) - label_2) AS md, stddev_samp(CAST(label_1 AS DOUBLE) - label_2) AS sd
  FROM {source} {where} GROUP BY {k}, bias_cat_1, bias_cat_2"""
    t = t_sql("n_pairs", "md", "sd")
    return f"""SELECT {k}, bias_cat_1_name, bias_cat_2_name, n_pairs,
  {r6('m1')} AS bias_cat_1_mean, {r6('m2')} AS bias_cat_2_mean, {r6('m1 - m2')} AS performance_gap,
  {r6('t')} AS t_statistic, {r6(t_p_sql('t', 'n_pairs - 1'))} AS statistical_significance
FROM (SELECT *, {t} AS t FROM ({inner}) q0) q1"""


# --- classification metrics ------------------------------------------------------------------------

def _kc(keys: list[str]) -> str:
    return "".join(k + ", " for k in keys)


def _gb(keys: list[str], *more: str) -> str:
    cols = list(keys) + list(more)
    return ("GROUP BY " + ", ".join(cols)) if cols else ""


def class_table_ctes(prefix: str, source: str, keys: list[str], gold: str, pred: str,
                     labels: list | None = None) -> str:
    """CTEs ``{prefix}_cls(keys, cls, tp, support, pred_n, precision, recall, f1)``."""
    kc = _kc(keys)
    lab_filter = ""
    grid = ""
    if labels is not None:
        lab_list = ", ".join(repr(v) if not isinstance(v, str) else f"'{v}'" for v in labels)
        lab_filter = f"WHERE cls IN ({lab_list})"
        join_on = " AND ".join([f"g.{k} = s.{k}" for k in keys] + ["g.cls = s.cls"])
        grid = f""",
{prefix}_slices AS (SELECT DISTINCT {kc}1 AS one FROM {prefix}_cc),
{prefix}_grid AS (SELECT {kc}u.cls FROM {prefix}_slices CROSS JOIN (SELECT unnest([{lab_list}]) AS cls) u),
{prefix}_cls0 AS (
  SELECT {''.join('g.' + k + ', ' for k in keys)}g.cls, coalesce(s.tp, 0) AS tp, coalesce(s.support, 0) AS support,
         coalesce(s.pred_n, 0) AS pred_n
  FROM {prefix}_grid g LEFT JOIN {prefix}_raw s ON {join_on}
)"""
    raw_name = f"{prefix}_raw" if labels is not None else f"{prefix}_cls0"
    return f"""{prefix}_cc AS (
  SELECT {kc}{gold} AS gold, {pred} AS pred, count(*) AS n FROM {source}
  WHERE {gold} IS NOT NULL AND {pred} IS NOT NULL {_gb(keys, gold, pred)}
),
{prefix}_contrib AS (
  SELECT {kc}gold AS cls, n AS gold_n, 0 AS pred_n, CASE WHEN gold = pred THEN n ELSE 0 END AS tp FROM {prefix}_cc
  UNION ALL
  SELECT {kc}pred AS cls, 0 AS gold_n, n AS pred_n, 0 AS tp FROM {prefix}_cc
),
{raw_name} AS (
  SELECT {kc}cls, sum(tp) AS tp, sum(gold_n) AS support, sum(pred_n) AS pred_n FROM {prefix}_contrib {lab_filter}
  {_gb(keys, 'cls')}
){grid},
{prefix}_cls AS (
  SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(pred_n, 0), 0.0) AS precision,
            coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0) AS recall,
            coalesce(2.0 * tp / nullif(support + pred_n, 0), 0.0) AS f1
  FROM {prefix}_cls0
)"""


def metrics_select(prefix: str, keys: list[str]) -> str:
    kc = _kc(keys)
    return f"""SELECT {kc}round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
  round(avg(f1), 6) AS f1, CAST(sum(support) AS BIGINT) AS support,
  round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS acc, count(*) AS n_classes
FROM {prefix}_cls {_gb(keys)}"""


def report_select(prefix: str, keys: list[str]) -> str:
    kc = _kc(keys)
    return f"""SELECT {kc}CAST(cls AS VARCHAR) AS row, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM {prefix}_cls
UNION ALL
SELECT {kc}'accuracy' AS row, NULL AS precision, NULL AS recall, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM {prefix}_cls {_gb(keys)}
UNION ALL
SELECT {kc}'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT)
FROM {prefix}_cls {_gb(keys)}
UNION ALL
SELECT {kc}'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM {prefix}_cls {_gb(keys)}"""


def confusion_sql(source: str, keys: list[str], row: str, col: str, labels: list, weight: str = "1") -> str:
    kc = _kc(keys)
    lab = ", ".join(repr(v) for v in labels)
    on = " AND ".join([f"g.{k} IS NOT DISTINCT FROM c.{k}" for k in keys]
                      + ["g.row_label = c.row_label", "g.col_label = c.col_label"])
    return f"""(WITH cm_src AS (SELECT * FROM {source} WHERE {row} IN ({lab}) AND {col} IN ({lab})),
cm_cnt AS (SELECT {kc}{row} AS row_label, {col} AS col_label, CAST(sum({weight}) AS BIGINT) AS n FROM cm_src
           {_gb(keys, row, col)}),
cm_grid AS (SELECT {kc}r.row_label, c2.col_label FROM (SELECT DISTINCT {kc}1 AS one FROM cm_src) s
            CROSS JOIN (SELECT unnest([{lab}]) AS row_label) r CROSS JOIN (SELECT unnest([{lab}]) AS col_label) c2)
SELECT {''.join('g.' + k + ', ' for k in keys)}CAST(g.row_label AS INTEGER) AS row_label,
       CAST(g.col_label AS INTEGER) AS col_label, coalesce(c.n, 0) AS n
FROM cm_grid g LEFT JOIN cm_cnt c ON {on})"""
