"""Exponential dispersion families, once for arrays and Columns alike."""

from __future__ import annotations

import math
import numbers
import re
from dataclasses import dataclass

import numpy as np

from .links import CloglogLink, IdentityLink, Link, LogitLink, LogLink, TweedieLink  # noqa: F401
from .maths import lgamma, maths, xlogy


class Family:
    """Subclass with a range, v, v' and a unit deviance to add a family."""

    lower, upper = -math.inf, math.inf
    include_lower = include_upper = False

    def default_link(self) -> Link:
        return IdentityLink()

    def in_y_range(self, y):
        low = y >= self.lower if self.include_lower else y > self.lower
        high = y <= self.upper if self.include_upper else y < self.upper
        return low & high

    def unit_variance(self, mu):
        raise NotImplementedError

    def unit_variance_derivative(self, mu):
        raise NotImplementedError

    def unit_deviance(self, y, mu):
        raise NotImplementedError

    def unit_log_likelihood(self, y, mu, weight, dispersion):
        raise NotImplementedError(f"{type(self).__name__} has no log-likelihood")

    def variance(self, mu, dispersion=1.0, weight=1.0):
        return self.unit_variance(mu) * dispersion / weight

    def variance_derivative(self, mu, dispersion=1.0, weight=1.0):
        return self.unit_variance_derivative(mu) * dispersion / weight

    def unit_deviance_derivative(self, y, mu):
        return -2 * (y - mu) / self.unit_variance(mu)

    def deviance(self, y, mu, weight=1.0):
        """The weighted sum of unit deviances: a number, or an aggregate Column."""
        return maths(y, mu, weight).total(weight * self.unit_deviance(y, mu))

    def deviance_derivative(self, y, mu, weight=1.0):
        return weight * self.unit_deviance_derivative(y, mu)

    def log_likelihood(self, y, mu, weight=None, dispersion=None):
        m = maths(y, mu)
        weight = y * 0 + 1 if weight is None else weight
        if dispersion is None:
            dispersion = self.dispersion(y, mu, weight, ddof=0, method="deviance") if self.estimates_dispersion else 1.0
        return m.total(self.unit_log_likelihood(y, mu, weight, dispersion))

    estimates_dispersion = True

    def dispersion(self, y, mu, weight=None, ddof=1, method="pearson"):
        m = maths(y, mu)
        weight = y * 0 + 1 if weight is None else weight
        if method == "pearson":
            return m.total(weight * (y - mu) * (y - mu) / self.unit_variance(mu)) / (m.total(weight) - ddof)
        if method == "deviance":
            return self.deviance(y, mu, weight) / (m.total(weight) - ddof)
        raise NotImplementedError(f"dispersion has the methods pearson and deviance, not {method}")

    def rows(self, link: Link, y, eta, mu, weight):
        """Gradient and curvature of minus half the deviance by eta, for each row.

        Gamma and Tweedie with a log link use the true second derivative, which is positive
        there; all others the expected one.
        """
        p = getattr(self.to_tweedie(), "p", None)
        if link == LogLink() and p is not None and (p == 2 or 1 < p < 2):
            scale = weight * maths(mu).power(mu, 1 - p)
            return scale * (y - mu), scale * (mu - (1 - p) * (y - mu))
        slope = link.inverse_derivative(eta)
        ratio = weight * slope / self.unit_variance(mu)
        return ratio * (y - mu), ratio * slope

    def fisher_weight(self, link, eta, mu, weight, dispersion=1.0):
        slope = link.inverse_derivative(eta)
        return weight * slope * slope / (self.unit_variance(mu) * dispersion)

    def observed_weight(self, link, y, eta, mu, weight, dispersion=1.0):
        v, dv = self.unit_variance(mu), self.unit_variance_derivative(mu)
        slope = link.inverse_derivative(eta)
        return weight / (v * dispersion) * (slope * slope * (1 + (y - mu) * dv / v) - link.inverse_derivative2(eta) * (y - mu))

    def score_weight(self, link, y, eta, mu, weight, dispersion=1.0):
        return weight * link.inverse_derivative(eta) * (y - mu) / (self.unit_variance(mu) * dispersion)

    def to_tweedie(self):
        return None

    def __eq__(self, other):
        return type(self) is type(other) and vars(self) == vars(other)

    def __hash__(self):
        return hash((type(self).__name__, *sorted(vars(self).items())))


class TweedieFamily(Family):
    """Variance mu ** p."""

    def __init__(self, p: float = 1.5):
        if not isinstance(p, numbers.Real) or isinstance(p, bool):
            raise TypeError(f"power must be numeric; got {p}")
        if 0 < p < 1:
            raise ValueError("For 0 < power < 1, no distribution exists.")
        self.p = p

    @property
    def lower(self):
        return -math.inf if self.p <= 0 else 0

    @property
    def include_lower(self):
        return 1 <= self.p < 2

    def default_link(self):
        return IdentityLink() if self.p <= 0 else LogLink()

    def to_tweedie(self):
        return TweedieFamily(self.p)

    def __eq__(self, other):
        return isinstance(other, TweedieFamily) and self.p == other.p

    __hash__ = Family.__hash__

    def unit_variance(self, mu):
        return mu * 0 + 1 if self.p == 0 else maths(mu).power(mu, self.p)

    def unit_variance_derivative(self, mu):
        return mu * 0 if self.p == 0 else self.p * maths(mu).power(mu, self.p - 1)

    def unit_deviance(self, y, mu):
        m, p = maths(y, mu), self.p
        if p == 0:
            return (y - mu) * (y - mu)
        if p == 1:
            return 2 * (xlogy(y, y / mu) - y + mu)
        if p == 2:
            return 2 * (m.log(mu / y) + y / mu - 1)
        if p == 3:
            return (y / mu - 1) * (y / mu - 1) / y
        own = m.power(m.maximum(y, 0.0), 2 - p) / ((1 - p) * (2 - p))
        return 2 * (own - y * m.power(mu, 1 - p) / (1 - p) + m.power(mu, 2 - p) / (2 - p))

    def unit_log_likelihood(self, y, mu, weight, dispersion):
        m, p, phi = maths(y, mu), self.p, dispersion
        log = lambda x: m.log(m.const(x) if isinstance(x, (int, float)) else x)
        if p == 0:
            return -weight * (y - mu) * (y - mu) / (2 * phi) - weight * log(2 * math.pi * phi) / 2
        if p == 1:
            return -weight * mu + weight * (xlogy(y, mu) - lgamma(y + 1.0))
        if p == 2:
            shape = 1 / phi
            return weight * ((m.log(y / mu) - y / mu) / phi - m.log(y) - log(phi) / phi - lgamma(shape if not isinstance(shape, (int, float)) else m.const(shape)))
        if p == 3:
            return -weight * ((y / mu - 1) * (y / mu - 1) / (2 * phi * y) + 1.5 * m.log(y)) - weight * log(2 * math.pi * phi) / 2
        if 1 < p < 2:
            return weight * tweedie_unit_log_likelihood(y, mu, p, phi)
        raise NotImplementedError(f"there is no log-likelihood for a power of {p}")


def tweedie_unit_log_likelihood(y: np.ndarray, mu: np.ndarray, p: float, phi: float) -> np.ndarray:
    """Log-density by the series of compound Poisson terms around its largest one.

    Terms more than 37 logarithmic units below the largest do not count. Arrays only: the series
    has no closed form for SQL.
    """
    y, mu = np.broadcast_arrays(np.asarray(y, float), np.asarray(mu, float))
    out = -np.power(mu, 2 - p) / (phi * (2 - p))
    at = np.flatnonzero(y > 0)
    if not len(at):
        return out
    v, u = y[at], mu[at]
    alpha = (2 - p) / (1 - p)
    base = alpha * np.log(p - 1) - alpha * np.log(v) - (1 - alpha) * np.log(phi) - np.log(2 - p)
    term = lambda j: j * base - lgamma(j + 1.0) - lgamma(-alpha * j)
    peak = np.maximum(1.0, np.rint(np.power(v, 2 - p) / (phi * (2 - p))))
    best = term(peak)
    total = np.ones(len(at))
    for step in (1.0, -1.0):
        j, live = peak + step, np.ones(len(at), bool)
        while True:
            live &= j >= 1
            if not live.any():
                break
            gap = term(np.where(live, j, 1.0)) - best
            live &= gap >= -37
            total += np.where(live, np.exp(np.minimum(gap, 50)), 0.0)
            j = j + step
    out = out.copy()
    out[at] += v * np.power(u, 1 - p) / (phi * (1 - p)) + best + np.log(total) - np.log(v)
    return out


class NormalFamily(TweedieFamily):
    def __init__(self):
        super().__init__(0)


class PoissonFamily(TweedieFamily):
    estimates_dispersion = False

    def __init__(self):
        super().__init__(1)


class GammaFamily(TweedieFamily):
    def __init__(self):
        super().__init__(2)


class InverseGaussianFamily(TweedieFamily):
    def __init__(self):
        super().__init__(3)


class BinomialFamily(Family):
    lower, upper, include_lower, include_upper = 0, 1, True, True
    estimates_dispersion = False

    def default_link(self):
        return LogitLink()

    def unit_variance(self, mu):
        return mu * (1 - mu)

    def unit_variance_derivative(self, mu):
        return 1 - 2 * mu

    def unit_deviance(self, y, mu):
        return -2 * (xlogy(y, mu) + xlogy(1 - y, 1 - mu))

    def unit_log_likelihood(self, y, mu, weight, dispersion):
        return -0.5 * weight * self.unit_deviance(y, mu)


class NegativeBinomialFamily(Family):
    """Variance mu + theta mu ** 2."""

    lower, include_lower = 0, True
    estimates_dispersion = False

    def __init__(self, theta: float = 1.0):
        if not isinstance(theta, numbers.Real) or isinstance(theta, bool):
            raise TypeError(f"theta must be numeric; got {theta}")
        if not theta > 0:
            raise ValueError(f"theta must be strictly positive; got {theta}")
        self.theta = theta

    def default_link(self):
        return LogLink()

    def unit_variance(self, mu):
        return mu + self.theta * mu * mu

    def unit_variance_derivative(self, mu):
        return 1 + 2 * self.theta * mu

    def unit_deviance(self, y, mu):
        r = 1 / self.theta
        return 2 * (xlogy(y, y / mu) - (y + r) * maths(y, mu).log((y + r) / (mu + r)))

    def unit_log_likelihood(self, y, mu, weight, dispersion):
        m, r = maths(y, mu), 1 / self.theta
        own = xlogy(y, self.theta * mu) - (y + r) * m.log(1 + self.theta * mu)
        return weight * (own + lgamma(y + r) - math.lgamma(r) - lgamma(y + 1.0))


class HyperbolicSecantFamily(Family):
    """Generalised hyperbolic secant: variance 1 + mu ** 2; by instance only."""

    def unit_variance(self, mu):
        return 1 + mu * mu

    def unit_variance_derivative(self, mu):
        return 2 * mu

    def unit_deviance(self, y, mu):
        m = maths(y, mu)
        return 2 * y * (m.atan(y) - m.atan(mu)) + m.log((1 + mu * mu) / (1 + y * y))


def get_family(family) -> Family:
    """A family by name or an instance."""
    if isinstance(family, Family):
        return family
    named = {
        "binomial": BinomialFamily, "gamma": GammaFamily, "gaussian": NormalFamily, "inverse.gaussian": InverseGaussianFamily,
        "normal": NormalFamily, "poisson": PoissonFamily, "tweedie": TweedieFamily, "negative.binomial": NegativeBinomialFamily,
    }
    if isinstance(family, str):
        if family in named:
            return named[family]()
        if found := re.fullmatch(r"tweedie\s?\((.+)\)", family):
            return TweedieFamily(float(found[1]))
        if found := re.fullmatch(r"negative.binomial\s?\((.+)\)", family):
            return NegativeBinomialFamily(float(found[1]))
    raise ValueError(f"family must be an instance of Family or one of {sorted(named)}, 'tweedie (p)', 'negative.binomial (theta)'; got {family!r}")
