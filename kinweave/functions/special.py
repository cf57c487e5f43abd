"""Distribution functions without a statistics library: numpy, Column and SQL forms.

Covers the scalar inventory of SURVEY 2.9: normal quantile, chi-square with one
degree of freedom, and the F distribution with one numerator degree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Coefficients of Wichura's AS 241 (1988), lowest power first, for the centre and the two tails.
AS241 = {
    "centre": (
        (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
        (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
    ),
    "near": (
        (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    ),
    "far": (
        (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
    ),
}
#: Median of the chi-square distribution with one degree of freedom.
CHI2_MEDIAN = 0.4549364231195728


def _ratio(kind: str, x):
    """Value of one of the rational forms; works on floats, arrays and Columns alike."""
    out = []
    for coefficients in AS241[kind]:
        value = coefficients[-1]
        for c in reversed(coefficients[:-1]):
            value = value * x + c
        out.append(value)
    return out[0] / out[1]


def norm_ppf(p: np.ndarray) -> np.ndarray:
    """Standard normal quantile; NaN outside [0, 1], infinite at its ends."""
    p = np.asarray(p, float)
    q = p - 0.5
    with np.errstate(all="ignore"):
        r = np.sqrt(-np.log(np.where(q < 0, p, 1 - p)))
        tail = np.where(r <= 5, _ratio("near", r - 1.6), _ratio("far", r - 5))
        out = np.where(np.abs(q) <= 0.425, q * _ratio("centre", 0.180625 - q * q), np.sign(q) * tail)
    out = np.where(p == 0, -np.inf, np.where(p == 1, np.inf, out))
    return np.where((p >= 0) & (p <= 1), out, np.nan)


def norm_ppf_col(p: Column) -> Column:
    """The same as a JVM expression."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    tail = F.when(r <= 5, _ratio("near", r - 1.6)).otherwise(_ratio("far", r - 5))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * _ratio("centre", 0.180625 - q * q)).otherwise(F.signum(q) * tail))


def norm_ppf_sql(p: str) -> str:
    """The same as SQL text over an expression without side effects."""

    def ratio(kind: str, x: str) -> str:
        forms = []
        for coefficients in AS241[kind]:
            text = f"{coefficients[-1]!r}::DOUBLE"
            for c in reversed(coefficients[:-1]):
                text = f"(({text})*({x})+{c!r}::DOUBLE)"
            forms.append(text)
        return f"({forms[0]}/{forms[1]})"

    q = f"(({p})-0.5)"
    r = f"sqrt(-ln(CASE WHEN {q}<0 THEN ({p}) ELSE 1-({p}) END))"
    return f"CASE WHEN abs({q})<=0.425 THEN {q}*{ratio('centre', f'(0.180625-{q}*{q})')} ELSE sign({q})*(CASE WHEN {r}<=5 THEN {ratio('near', f'({r}-1.6)')} ELSE {ratio('far', f'({r}-5)')} END) END"


def chi2_isf(p: np.ndarray) -> np.ndarray:
    """Upper quantile of chi-square with one degree of freedom, accurate in the tail."""
    return norm_ppf(np.asarray(p, float) / 2) ** 2


def chi2_isf_col(p: Column) -> Column:
    z = norm_ppf_col(p / 2)
    return z * z


def f_sf(f: np.ndarray, nu: np.ndarray | float) -> np.ndarray:
    """P(F(1, nu) > f): the regularised incomplete beta I_x(nu/2, 1/2), x = nu/(nu+f), by Lentz's continued fraction."""
    f, nu = np.broadcast_arrays(np.asarray(f, float), np.asarray(nu, float))
    out = np.full(f.shape, np.nan)
    good = np.isfinite(f) & (f >= 0) & (nu > 0)
    out[np.isposinf(f) & (nu > 0)] = 0.0
    if good.any():
        out[good] = _beta(f[good], nu[good])
    return out


def _beta(f: np.ndarray, nu: np.ndarray) -> np.ndarray:
    a, b = nu / 2, np.full_like(nu, 0.5)
    x, y = nu / (nu + f), f / (nu + f)
    gamma = np.array([math.lgamma(v + 0.5) - math.lgamma(v) - math.lgamma(0.5) for v in np.unique(a)])
    front = gamma[np.searchsorted(np.unique(a), a)]
    with np.errstate(divide="ignore", invalid="ignore"):
        log_front = front + a * np.log(x) + b * np.log(y)
        swap = x > (a + 1) / (a + b + 2)
        p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, y, x)
        part = np.exp(log_front) * _fraction(p, q, z) / p
    part = np.where(f == 0, 0.0 * swap, part)
    return np.clip(np.where(swap, 1 - part, part), 0, 1)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return h


def f_isf(p: float, nu: float) -> float:
    """f with f_sf(f, nu) = p, by bisection on log f."""
    if not 0 < p < 1:
        return math.inf if p == 0 else 0.0 if p == 1 else math.nan
    lo, hi = -60.0, 60.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if f_sf(np.array([math.exp(mid)]), nu)[0] > p:
            lo = mid
        else:
            hi = mid
    return math.exp((lo + hi) / 2)


@F.pandas_udf(DoubleType())
def f_sf_udf(f: pd.Series, nu: pd.Series) -> pd.Series:
    return pd.Series(f_sf(f.to_numpy(float), nu.to_numpy(float)))


def f_sf_sql(f: str, nu: str) -> str:
    """SQL text for whole degrees of freedom (finite sums of A&S 26.7.3 and 26.7.4), for engines without a library."""
    theta = f"atan(sqrt(({f})/({nu})))"
    even = f"1-sin({theta})*list_sum(list_transform(range(0, CAST(({nu})/2 AS BIGINT)), lambda j: exp(lgamma(j+0.5)-lgamma(j+1.0)-0.5*ln(pi())+2*j*ln(cos({theta})))))"
    odd = f"1-2/pi()*({theta}+CASE WHEN ({nu})>1 THEN sin({theta})*list_sum(list_transform(range(0, CAST((({nu})-1)/2 AS BIGINT)), lambda j: exp(lgamma(j+1.0)-lgamma(j+1.5)+0.5*ln(pi())+(2*j+1)*ln(cos({theta})))))/2*1 ELSE 0 END)"
    return f"CASE WHEN ({nu})%2=0 THEN {even} ELSE {odd} END"


def register(spark) -> None:
    """norm_ppf, f_sf and chi2_isf as SQL functions of a session."""
    spark.udf.register("f_sf", f_sf_udf)
    spark.udf.register("norm_ppf", F.pandas_udf(lambda p: pd.Series(norm_ppf(p.to_numpy(float))), "double"))
    spark.udf.register("chi2_isf", F.pandas_udf(lambda p: pd.Series(chi2_isf(p.to_numpy(float))), "double"))
    spark.udf.register("f_isf", F.pandas_udf(_isf_series, "double"))


def _isf_series(p: pd.Series, nu: pd.Series) -> pd.Series:
    return pd.Series([f_isf(float(a), float(b)) for a, b in zip(p, nu, strict=True)])
