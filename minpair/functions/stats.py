"""Statistics as native column expressions.

Spark SQL has no Student-t distribution, so the two-sided p-value of a t statistic is computed from
the regularised incomplete beta function ``p = I_{v/(v+t^2)}(v/2, 1/2)``, evaluated by the modified
Lentz continued fraction inside a higher-order ``aggregate`` (JVM side, no Python worker). From
``_LARGE_DOF`` degrees of freedom on, where the beta's factors would cancel, t is turned into a
normal deviate by Hill's expansion (its error falls with the square of the dof and is below 1e-11
there) and the normal tail is used. Both loops have a fixed number of steps. They are only ever
applied to aggregated rows (one per slice), so they do not touch the data path.

The expressions are Spark SQL text: one parse on the JVM instead of thousands of Column calls.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TINY = 1e-300
_EPS = 3e-16
_LN_SQRT_2PI = 0.5 * math.log(2 * math.pi)
_LARGE_DOF = 10_000
_TERMS = 600  # enough for the continued fraction below _LARGE_DOF (it needs about 8 sqrt(dof / 2))
_SHIFT = 10  # lgamma(z) = lgamma(z + SHIFT) - ln(z (z+1) ... (z+SHIFT-1)); Stirling beyond


def lgamma_sql(z: str) -> str:
    w = f"({z} + {float(_SHIFT)})"
    series = (f"(1.0 / (12.0 * {w}) - 1.0 / (360.0 * power({w}, 3)) + 1.0 / (1260.0 * power({w}, 5)) "
              f"- 1.0 / (1680.0 * power({w}, 7)))")
    shift = " + ".join(f"ln({z} + {float(k)})" for k in range(_SHIFT))
    return f"(({w} - 0.5) * ln({w}) - {w} + {_LN_SQRT_2PI!r} + {series} - ({shift}))"


def _fix_sql(x: str) -> str:
    return f"(CASE WHEN abs({x}) < {_TINY!r} THEN {_TINY!r} ELSE {x} END)"


def _beta_cf_sql(a: str, b: str, x: str, max_terms: str) -> str:
    """Lentz iteration as micro-steps over one accumulator, so each sub-expression appears once:
    k % 3 = 0 computes the coefficient, 1 updates d and c, 2 updates h and the stop flag."""
    qab, qap, qam = f"({a} + {b})", f"({a} + 1.0)", f"({a} - 1.0)"
    j = "(CAST(k / 3 AS INT) + 1)"
    m = f"CAST(ceil({j} / 2) AS DOUBLE)"
    odd = f"({j} % 2 = 1)"
    aa = (f"CASE WHEN {odd} THEN {m} * ({b} - {m}) * {x} / (({qam} + 2.0 * {m}) * ({a} + 2.0 * {m})) "
          f"ELSE -({a} + {m}) * ({qab} + {m}) * {x} / (({a} + 2.0 * {m}) * ({qap} + 2.0 * {m})) END")
    d0 = f"(1.0 / {_fix_sql(f'1.0 - {qab} * {x} / {qap}')})"
    st = "named_struct('aa', {aa}, 'c', {c}, 'd', {d}, 'h', {h}, 'done', {done})"
    coef = st.format(aa=aa, c="acc.c", d="acc.d", h="acc.h", done="acc.done")
    upd = st.format(aa="acc.aa", c=_fix_sql("1.0 + acc.aa / acc.c"),
                    d=f"1.0 / {_fix_sql('1.0 + acc.aa * acc.d')}", h="acc.h", done="acc.done")
    fin = st.format(aa="acc.aa", c="acc.c", d="acc.d", h="acc.h * acc.d * acc.c",
                    done=f"(NOT {odd}) AND abs(acc.d * acc.c - 1.0) < {_EPS!r}")
    step = f"CASE WHEN acc.done THEN acc WHEN k % 3 = 0 THEN {coef} WHEN k % 3 = 1 THEN {upd} ELSE {fin} END"
    init = f"named_struct('aa', 0.0D, 'c', 1.0D, 'd', {d0}, 'h', {d0}, 'done', false)"
    return f"aggregate(sequence(0, CAST(6 * {max_terms} AS INT) - 1), {init}, (acc, k) -> {step}, acc -> acc.h)"


def ibeta_sql(x: str, a: str, b: str, ln_front: str | None = None) -> str:
    """I_x(a, b) as SQL text over column names / literals (``ln_front``: a staged column with the
    log of the beta front factor, else computed inline)."""
    terms = str(_TERMS)
    if ln_front is None:
        ln_front = (f"({lgamma_sql(f'({a} + {b})')} - {lgamma_sql(a)} - {lgamma_sql(b)} "
                    f"+ {a} * ln(greatest({x}, {_TINY!r})) + {b} * ln(greatest(1.0 - {x}, {_TINY!r})))")
    front = f"exp({ln_front})"
    direct = f"({front} * {_beta_cf_sql(a, b, x, terms)} / {a})"
    mirrored = f"(1.0 - {front} * {_beta_cf_sql(b, a, f'(1.0 - {x})', terms)} / {b})"
    return (f"(CASE WHEN {x} <= 0.0 THEN 0.0D WHEN {x} >= 1.0 THEN 1.0D "
            f"WHEN {x} < ({a} + 1.0) / ({a} + {b} + 2.0) THEN {direct} ELSE {mirrored} END)")


def erfc_sql(x: str) -> str:
    """Complementary error function for x >= 0: the positive series of erf below 2.5, the continued
    fraction from the far end above."""
    series = (f"aggregate(sequence(1, 80), named_struct('t', {x}, 's', {x}), (a, k) -> named_struct("
              f"'t', a.t * 2 * {x} * {x} / (2 * k + 1), 's', a.s + a.t * 2 * {x} * {x} / (2 * k + 1)), a -> a.s)")
    fraction = f"aggregate(sequence(80, 1, -1), {x}, (f, k) -> {x} + k / 2.0D / f)"
    return (f"(CASE WHEN {x} < 2.5D THEN 1.0D - {2 / math.sqrt(math.pi)!r}D * exp(-{x} * {x}) * {series} "
            f"ELSE exp(-{x} * {x}) / ({math.sqrt(math.pi)!r}D * {fraction}) END)")


def _hill_sql(t: str, v: str) -> str:
    """Normal deviate with the two-sided tail of |t| at ``v`` degrees of freedom, over sqrt(2)."""
    y = f"(({v} - 0.5D) * log1p({t} * {t} / {v}))"
    b = f"(48.0D * ({v} - 0.5D) * ({v} - 0.5D))"
    return (f"(((((-0.4D * {y} - 3.3D) * {y} - 24.0D) * {y} - 85.5D) / (0.8D * {y} * {y} + 100.0D + {b}) + {y} + 3.0D) / {b} + 1.0D) "
            f"* sqrt({y}) * {math.sqrt(0.5)!r}D")


def with_t_p_value(df: DataFrame, t: str, dof: Column, out: str = "statistical_significance") -> DataFrame:
    """Add the two-sided p of column ``t`` as ``out``; inputs are staged in their own projections."""
    staged = df.withColumns({"__t": F.col(t), "__v": dof.cast("double")})
    staged = staged.withColumns({"__x": F.col("__v") / (F.col("__v") + F.col("__t") * F.col("__t")),
                                 "__a": F.col("__v") / 2.0,
                                 "__z": F.expr(_hill_sql("`__t`", "`__v`"))})
    x, a = "`__x`", "`__a`"
    staged = staged.withColumn("__lf", F.expr(
        f"{lgamma_sql(f'({a} + 0.5D)')} - {lgamma_sql(a)} - {lgamma_sql('0.5D')} "
        f"+ {a} * ln(greatest({x}, {_TINY!r})) + 0.5D * ln(greatest(1.0 - {x}, {_TINY!r}))"))
    ib = ibeta_sql(x, a, "0.5D", ln_front="`__lf`")
    p = F.expr(f"CASE WHEN `__t` IS NULL OR isnan(`__t`) OR `__v` <= 0 THEN CAST(NULL AS DOUBLE) "
               f"WHEN abs(`__t`) = double('inf') THEN 0.0D "
               f"WHEN `__v` >= {_LARGE_DOF} THEN {erfc_sql('`__z`')} ELSE least(1.0D, greatest(0.0D, {ib})) END")
    return staged.withColumn(out, p).drop("__t", "__v", "__x", "__a", "__z", "__lf")


def paired_t(n: Column, mean: Column, sd: Column) -> Column:
    """t of a paired test from count, mean and sample sd of the differences.

    sd = 0: mean = 0 gives NULL (undefined), otherwise +/-infinity (p = 0). n < 2: NULL.
    """
    se = sd / F.sqrt(n.cast("double"))
    return (F.when((n < 2) | sd.isNull(), F.lit(None).cast("double"))
            .when(sd == 0, F.when(mean == 0, F.lit(None).cast("double"))
                  .when(mean > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
            .otherwise(mean / se))
