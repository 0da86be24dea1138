"""Math expressions Spark lacks as built-ins, written as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def erf(x: Column) -> Column:
    """Abramowitz-Stegun 7.1.26 rational approximation (|error| < 1.5e-7).

    Fixed values (published coefficients of formula 7.1.26):
    p = 0.3275911, a1..a5 = 0.254829592, -0.284496736, 1.421413741,
    -1.453152027, 1.061405429.
    """
    p = 0.3275911
    a1, a2, a3, a4, a5 = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * ax)
    poly = ((((F.lit(a5) * t + a4) * t + a3) * t + a2) * t + a1) * t
    y = F.lit(1.0) - poly * F.exp(-ax * ax)
    return F.signum(x) * y


def normal_cdf(z: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(z / F.lit(math.sqrt(2.0))))


def py_erf(x: float) -> float:
    """Same polynomial on the driver, for scalar statistics."""
    p = 0.3275911
    a1, a2, a3, a4, a5 = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    s = 1.0 if x >= 0 else -1.0
    ax = abs(x)
    t = 1.0 / (1.0 + p * ax)
    poly = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t
    return s * (1.0 - poly * math.exp(-ax * ax))


def frobenius(values: Column) -> Column:
    """Aggregate: Frobenius norm ``sqrt(sum(r*r))`` of a long-form matrix column."""
    return F.sqrt(F.sum(values * values))


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution (series for the regularised gamma)."""
    if x <= 0:
        return 1.0
    a = dof / 2.0
    z = x / 2.0
    # lower regularised gamma by series, upper by continued fraction (Numerical Recipes style)
    if z < a + 1:
        term = 1.0 / a
        total = term
        n = 1
        while n < 1000:
            term *= z / (a + n)
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
            n += 1
        lower = total * math.exp(-z + a * math.log(z) - math.lgamma(a))
        return max(0.0, 1.0 - lower)
    b = z + 1 - a
    c = 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return math.exp(-z + a * math.log(z) - math.lgamma(a)) * h
