"""Column helpers for missing values, safe division and normal / Kolmogorov probabilities."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acklam's rational approximation of the normal quantile.
CENTRAL_NUM = (
    -3.969683028665376e01,
    2.209460984245205e02,
    -2.759285104469687e02,
    1.383577518672690e02,
    -3.066479806614716e01,
    2.506628277459239e00,
)
CENTRAL_DEN = (
    -5.447609879822406e01,
    1.615858368580409e02,
    -1.556989798598866e02,
    6.680131188771972e01,
    -1.328068155288572e01,
    1.0,
)
TAIL_NUM = (
    -7.784894002430293e-03,
    -3.223964580411365e-01,
    -2.400758277161838e00,
    -2.549732539343734e00,
    4.374664141464968e00,
    2.938163982698783e00,
)
TAIL_DEN = (
    7.784695709041462e-03,
    3.224671290700398e-01,
    2.445134137142996e00,
    3.754408661907416e00,
    1.0,
)
TAIL_CUT = 0.02425
# Hart's rational approximation of the normal distribution, and where its continued fraction takes over.
NORMAL_NUM = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
NORMAL_DEN = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
NORMAL_CUT = 7.07106781186547
#: Rows a sample up to which the two-sample Kolmogorov-Smirnov p-value is exact.
EXACT_KS = 10_000


def clean(column: Column | str) -> Column:
    """NaN becomes NULL, so that one missing marker reaches the aggregates."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c), c)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL, not an ANSI error, on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column) -> Column:
    """Inverse standard-normal distribution, NULL outside (0, 1)."""
    q = p - 0.5
    r = q * q
    central = _horner(CENTRAL_NUM, r) * q / _horner(CENTRAL_DEN, r)

    def tail(prob: Column) -> Column:
        t = F.sqrt(-2.0 * F.ln(prob))
        return _horner(TAIL_NUM, t) / _horner(TAIL_DEN, t)

    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < TAIL_CUT, tail(p))
        .when(p <= 1 - TAIL_CUT, central)
        .otherwise(-tail(1 - p))
    )


def normal_upper(z: Column) -> Column:
    """Probability that a standard normal variable exceeds z."""
    x = F.least(F.abs(z), F.lit(37.0))
    bell = F.exp(-x * x / 2)
    fraction = x + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = x + F.lit(k) / fraction
    near = bell * _horner(NORMAL_NUM, x) / _horner(NORMAL_DEN, x)
    tail = F.when(x < NORMAL_CUT, near).otherwise(bell / fraction / math.sqrt(2 * math.pi))
    return F.when(z > 0, tail).otherwise(1.0 - tail)


def shapiro_francia_p(w: Column, n: Column) -> Column:
    """Royston's approximation of how likely normal rows give a W' as small; NULL under five rows.

    log(1 - W') is nearly normal, with a mean and deviation that depend on the number of rows (fitted up to 5,000).
    """
    u = F.log(n.cast("double"))
    v = F.log(u)
    mean, deviation = -1.2725 + 1.0521 * (v - u), 1.0308 - 0.26758 * (v + 2 / u)
    left = 1.0 - w
    p = F.when(left <= 0, F.lit(1.0)).otherwise(normal_upper((F.log(left) - mean) / deviation))
    return F.when((n >= 5) & w.isNotNull(), p)


def exact_kolmogorov_p(statistic: Column, n: Column) -> Column:
    """Exact two-sample Kolmogorov-Smirnov p-value of two samples of n rows each.

    Orders of both samples are lattice paths; those that leave a band of k = n * statistic are counted by
    reflection: 2 sum over i of (-1)^(i+1) C(2n, n + ik) / C(2n, n), the ratios built up factor by factor.
    """
    k = F.round(statistic * n).cast("long")
    start = F.struct(F.lit(1.0).alias("ratio"), F.lit(0.0).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        ratio_here = a["ratio"] * (n - j + 1) / (n + j)
        sign = F.when((j / k).cast("long") % 2 == 1, 1.0).otherwise(-1.0)
        return F.struct(ratio_here.alias("ratio"), F.when(j % k == 0, a["sum"] + sign * ratio_here).otherwise(a["sum"]).alias("sum"))

    paths = F.aggregate(F.sequence(F.lit(1).cast("long"), n.cast("long")), start, step, lambda a: 2 * a["sum"])
    return F.when(k == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), paths)))


def kolmogorov_p(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    lam = statistic * F.sqrt(ratio(n * m, n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2.0 * k * k * lam * lam),
    )
    p = F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))
    return F.when(lam.isNotNull(), p)
