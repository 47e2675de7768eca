"""Link functions: g(mu), its derivative, the inverse h(eta) and h's two derivatives."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from .maths import maths

_EDGE = 50 * np.finfo(np.float64).eps


class Link:
    """Subclass with the five functions to add a link; all take arrays or Columns."""

    def link(self, mu):
        raise NotImplementedError

    def derivative(self, mu):
        raise NotImplementedError

    def inverse(self, eta):
        raise NotImplementedError

    def inverse_derivative(self, eta):
        raise NotImplementedError

    def inverse_derivative2(self, eta):
        raise NotImplementedError

    def to_tweedie(self):
        return None


@dataclass(frozen=True)
class TweedieLink(Link):
    """mu ** (1 - p); identity at p = 0 and log at p = 1."""

    p: float = 1.5

    def _checked(self, out):
        if isinstance(out, (np.ndarray, float)) and not np.isfinite(out).all():
            raise ValueError(f"the link with power {self.p} has no value for these arguments")
        return out

    def link(self, mu):
        m = maths(mu)
        return mu if self.p == 0 else m.log(mu) if self.p == 1 else m.power(mu, 1 - self.p)

    def derivative(self, mu):
        m = maths(mu)
        return mu * 0 + 1 if self.p == 0 else 1 / mu if self.p == 1 else (1 - self.p) * m.power(mu, -self.p)

    def inverse(self, eta):
        m = maths(eta)
        if self.p in (0, 1):
            return eta if self.p == 0 else m.exp(eta)
        with np.errstate(all="ignore"):
            return self._checked(m.power(eta, 1 / (1 - self.p)))

    def inverse_derivative(self, eta):
        m, p = maths(eta), self.p
        if p in (0, 1):
            return eta * 0 + 1 if p == 0 else m.exp(eta)
        with np.errstate(all="ignore"):
            return self._checked(m.power(eta, p / (1 - p)) / (1 - p))

    def inverse_derivative2(self, eta):
        m, p = maths(eta), self.p
        if p in (0, 1):
            return eta * 0 if p == 0 else m.exp(eta)
        with np.errstate(all="ignore"):
            return self._checked(p / (1 - p) ** 2 * m.power(eta, (2 * p - 1) / (1 - p)))

    def to_tweedie(self):
        return self


class IdentityLink(TweedieLink):
    def __init__(self):
        super().__init__(0)


class LogLink(TweedieLink):
    def __init__(self):
        super().__init__(1)


@dataclass(frozen=True)
class LogitLink(Link):
    def link(self, mu):
        return maths(mu).log(mu / (1 - mu))

    def derivative(self, mu):
        return 1 / (mu * (1 - mu))

    def inverse(self, eta):
        m = maths(eta)
        return m.minimum(m.maximum(1 / (1 + m.exp(-eta)), _EDGE), 1 - _EDGE)

    def inverse_derivative(self, eta):
        p = self.inverse(eta)
        return p * (1 - p)

    def inverse_derivative2(self, eta):
        p = self.inverse(eta)
        return p * (1 - p) * (1 - 2 * p)


@dataclass(frozen=True)
class CloglogLink(Link):
    def link(self, mu):
        m = maths(mu)
        return m.log(-m.log1p(-mu))

    def derivative(self, mu):
        m = maths(mu)
        return 1 / ((mu - 1) * m.log1p(-mu))

    def inverse(self, eta):
        m = maths(eta)
        return m.minimum(m.maximum(-m.expm1(-m.exp(eta)), _EDGE), 1 - _EDGE)

    def inverse_derivative(self, eta):
        m = maths(eta)
        return m.exp(eta - m.exp(eta))

    def inverse_derivative2(self, eta):
        m = maths(eta)
        return -m.exp(eta - m.exp(eta)) * m.expm1(eta)


def get_link(link, family) -> Link:
    """A link by name (``auto``: the family's own) or an instance."""
    if isinstance(link, Link):
        return link
    if link == "auto":
        return family.default_link()
    named = {"identity": IdentityLink, "log": LogLink, "logit": LogitLink, "cloglog": CloglogLink, "tweedie": TweedieLink}
    if link in named:
        return named[link]()
    if isinstance(link, str) and (found := re.fullmatch(r"tweedie\s?\((.+)\)", link)):
        return TweedieLink(float(found[1]))
    raise ValueError(f"The link must be an instance of Link or one of 'auto', 'identity', 'log', 'logit', 'cloglog', 'tweedie', 'tweedie (p)'; got {link!r}: link must be known")
