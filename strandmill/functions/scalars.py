"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column, default: float | None = None) -> Column:
    """Null for NaN and infinities; then the default, if any."""
    out = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return out if default is None else F.coalesce(out, F.lit(default))


def cap(x: Column, most: float = 20.0) -> Column:
    """x within -most and most; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(most)), F.lit(-most)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(a, b)


def sigmoid(x: Column) -> Column:
    """The logistic function, without overflow for large |x|."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)), without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def shifted_sigmoid(x: Column, at: float, steepness: float) -> Column:
    return sigmoid(steepness * (x - at))


def ramp(x: Column, a: float, b: float) -> Column:
    """0 below a, 1 above b, linear between."""
    return clip((x - a) / (b - a), 0.0, 1.0)


#: Coefficients of the rational approximation of the normal tail (Abramowitz and Stegun 26.2.17) ...
CDF = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
#: ... and of the inverse (Acklam): central numerator and denominator, tail numerator and denominator.
PPF_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
PPF_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
PPF_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
PPF_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
_LOW = 0.02425


def horner(x: str, of: tuple) -> str:
    """A polynomial as SQL, highest power first."""
    out = _double(of[0])
    for c in of[1:]:
        out = f"(({out}) * ({x}) + ({_double(c)}))"
    return out


def _double(c: float) -> str:
    """A literal that is a double, not a decimal, in any engine."""
    return f"{c!r}e0" if "e" not in repr(c) else repr(c)


def normal_cdf_sql(x: str) -> str:
    """Normal distribution function as SQL that Spark and other engines read; within 1e-7."""
    t = f"(1 / (1 + {_double(CDF[0])} * abs({x})))"
    tail = f"(exp(-0.5e0 * ({x}) * ({x})) * 0.3989422804014327e0 * {t} * {horner(t, CDF[:0:-1])})"
    return f"(CASE WHEN ({x}) >= 0 THEN 1 - {tail} ELSE {tail} END)"


def normal_ppf_sql(p: str) -> str:
    """Inverse of the normal distribution function as SQL; relative error below 2e-9; null outside (0, 1)."""
    q = f"(({p}) - 0.5e0)"
    mid = f"({q} * {horner(f'({q} * {q})', PPF_A)} / {horner(f'({q} * {q})', PPF_B)})"
    end = lambda of: f"({horner(f'sqrt(-2 * ln({of}))', PPF_C)} / {horner(f'sqrt(-2 * ln({of}))', PPF_D)})"
    return f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN ({p}) < {_LOW} THEN {end(p)} WHEN ({p}) <= {1 - _LOW} THEN {mid} ELSE -{end(f'(1 - ({p}))')} END)"


def normal_cdf(x: str) -> Column:
    return F.expr(normal_cdf_sql(x))


def normal_ppf(p: str) -> Column:
    return F.expr(normal_ppf_sql(p))


def chi2_tail_sql(x: str, df: int) -> str:
    """Upper tail of the chi-squared distribution: closed for even df, by the normal tail for odd."""
    if df % 2 == 0:
        terms, term = ["1"], "1"
        for k in range(1, df // 2):
            term = f"({term}) * (({x}) / 2.0) / {k}"
            terms.append(term)
        return f"(exp(-({x}) / 2.0) * ({' + '.join(terms)}))"
    out, term = f"(2 * (1 - {normal_cdf_sql(f'sqrt({x})')}))", f"sqrt(2 * ({x}) / 3.141592653589793) * exp(-({x}) / 2.0)"
    for k in range(1, (df + 1) // 2):
        out += f" + {term}"
        term = f"({term}) * ({x}) / {2 * k + 1}"
    return f"({out})"


def nearest_power_of_two(x: Column) -> Column:
    """The power of two (1 at least) nearest to x by distance, the lower of two as near."""
    low = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(x, F.lit(1.0)))))
    return F.when(x - low <= 2 * low - x, low).otherwise(2 * low)


def to_grid(x: Column, step: float) -> Column:
    return F.round(x / step) * step
