"""One set of scalar functions for two worlds: NumPy arrays and Spark Columns.

Families and links are written once against these names. With Columns the result is an
expression inside whole-stage codegen; with arrays it is the vectorised body of a partial
aggregate.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class NumpyMaths:
    log, log1p, exp, expm1, sqrt, atan, power = np.log, np.log1p, np.exp, np.expm1, np.sqrt, np.arctan, np.power
    where, maximum, minimum = np.where, np.maximum, np.minimum
    total = staticmethod(np.sum)

    @staticmethod
    def const(x):
        return np.float64(x)


class ColumnMaths:
    log1p, exp, expm1, sqrt, atan = F.log1p, F.exp, F.expm1, F.sqrt, F.atan
    log = staticmethod(lambda x: F.ln(x))
    power = staticmethod(lambda x, p: F.pow(x, F.lit(float(p)) if not isinstance(p, Column) else p))
    where = staticmethod(lambda c, a, b: F.when(c, a).otherwise(b))
    maximum = staticmethod(lambda a, b: F.greatest(*(x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b))))
    minimum = staticmethod(lambda a, b: F.least(*(x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b))))
    total = staticmethod(F.sum)

    @staticmethod
    def const(x):
        return F.lit(float(x))


def maths(*values):
    return ColumnMaths if any(isinstance(v, Column) for v in values) else NumpyMaths


def xlogy(x, y):
    """``x * log(y)``, 0 where x is 0."""
    m = maths(x, y)
    zero = x == 0
    return m.where(zero, m.const(0.0), x * m.log(m.where(zero, m.const(1.0), y)))


#: Coefficients of Stirling's series, B(2k) / (2k (2k - 1)).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def lgamma(x):
    """Logarithm of the gamma function for positive arguments: Stirling's series seven places up."""
    m = maths(x)
    up, shift = x + 7.0, x
    for k in range(1, 7):
        shift = shift * (x + float(k))
    inverse, series = 1.0 / up, 0.0
    square = inverse * inverse
    for c in reversed(STIRLING):
        series = c + square * series
    return (up - 0.5) * m.log(up) - up + 0.5 * math.log(2 * math.pi) + series * inverse - m.log(shift)


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = h = 1 / b
    for k in range(1, 1000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: int) -> float:
    return gamma_tail(df / 2, x / 2)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_tails(z: float) -> float:
    """Probability of a normal value further from 0 than ``z``."""
    return math.erfc(abs(z) / math.sqrt(2))
