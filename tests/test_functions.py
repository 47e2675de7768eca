import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import families as fam
from fathom.functions import links as lk
from fathom.functions.maths import chi2_tail, lgamma, normal_tails

FAMILIES = [fam.NormalFamily(), fam.PoissonFamily(), fam.GammaFamily(), fam.InverseGaussianFamily(), fam.TweedieFamily(1.5), fam.BinomialFamily(), fam.NegativeBinomialFamily(0.7), fam.HyperbolicSecantFamily()]
LINKS = [lk.IdentityLink(), lk.LogLink(), lk.LogitLink(), lk.CloglogLink(), lk.TweedieLink(1.5), lk.TweedieLink(2.5)]


# Deviance, Pearson dispersion and log-likelihood of intercept-only models.
@pytest.mark.parametrize(
    "family,y,mu,deviance,dispersion,likelihood",
    [
        (fam.PoissonFamily(), [0, 0, 1, 2, 3], math.exp(0.1823216), 7.176404, 1.416667, -7.390977),
        (fam.GammaFamily(), [1, 2, 2, 3, 4], math.exp(0.8754687), 1.012285, 0.2256944, -7.057068),
        (fam.NormalFamily(), [-1, -1, 0, 1, 2], 0.2, 6.8, 1.7, -7.863404),
        (fam.TweedieFamily(1.5), [0, 0, 1, 2, 3], math.exp(0.1823216), 10.64769, 1.293234, -8.35485),
        (fam.BinomialFamily(), [0, 1, 0, 1, 0], 1 / (1 + math.exp(0.4054651)), 6.730117, 1.25, -3.365058),
        (fam.NegativeBinomialFamily(1.0), [0, 1, 0, 1, 0], math.exp(-0.9162907), 2.830597, 0.535714, -4.187887),
    ],
)
def test_known_constants(family, y, mu, deviance, dispersion, likelihood):
    y, mu = np.array(y, float), np.full(5, mu)
    assert family.deviance(y, mu) == pytest.approx(deviance, rel=1e-6)
    assert family.dispersion(y, mu) == pytest.approx(dispersion, rel=1e-5)
    assert family.log_likelihood(y, mu) == pytest.approx(likelihood, rel=1e-6)
    kinds, counts = np.unique(y, return_counts=True)
    assert family.deviance(kinds, mu[: len(kinds)], counts.astype(float)) == pytest.approx(deviance, rel=1e-6)


@pytest.mark.parametrize("family", FAMILIES, ids=lambda f: type(f).__name__)
def test_derivatives_by_differences(family):
    y, mu, h = np.array([0.3, 0.9, 0.5]), np.array([0.4, 0.6, 0.7]), 1e-6
    assert (family.unit_deviance(y, mu + h) - family.unit_deviance(y, mu - h)) / (2 * h) == pytest.approx(family.unit_deviance_derivative(y, mu), rel=1e-4)
    assert (family.unit_variance(mu + h) - family.unit_variance(mu - h)) / (2 * h) == pytest.approx(family.unit_variance_derivative(mu), rel=1e-4, abs=1e-8)
    assert family.in_y_range(y).all()


@pytest.mark.parametrize("link", LINKS, ids=repr)
def test_links_invert(link):
    eta, h = np.array([0.3, 0.6, 0.9]), 1e-6
    mu = link.inverse(eta)
    assert link.link(mu) == pytest.approx(eta, rel=1e-9)
    assert (link.inverse(eta + h) - link.inverse(eta - h)) / (2 * h) == pytest.approx(link.inverse_derivative(eta), rel=1e-5)
    assert (link.inverse_derivative(eta + h) - link.inverse_derivative(eta - h)) / (2 * h) == pytest.approx(link.inverse_derivative2(eta), rel=1e-4, abs=1e-8)
    assert link.derivative(mu) == pytest.approx(1 / link.inverse_derivative(eta), rel=1e-9)


def test_columns_agree_with_arrays(spark):
    y, mu = np.array([0.25, 0.5, 1.0]), np.array([0.4, 0.6, 0.7])
    df = spark.createDataFrame(list(zip(y.tolist(), mu.tolist())), "y double, mu double")
    for f in FAMILIES:
        got = [r[0] for r in df.select(f.unit_deviance(F.col("y"), F.col("mu"))).collect()]
        assert got == pytest.approx(f.unit_deviance(y, mu), rel=1e-9, abs=1e-12)
    for g in LINKS:
        assert [r[0] for r in df.select(g.inverse(F.col("y"))).collect()] == pytest.approx(g.inverse(y), rel=1e-12)


def test_special_functions():
    for x in (0.01, 0.5, 1, 2.5, 30, 1e5):
        assert lgamma(np.array([x]))[0] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert chi2_tail(18.307038053275143, 10) == pytest.approx(0.05, rel=1e-9)
    assert normal_tails(1.959963984540054) == pytest.approx(0.05, rel=1e-9)


def test_parsing_and_errors():
    assert fam.get_family("tweedie (1.7)").p == 1.7 and fam.get_family("negative.binomial(2)").theta == 2.0
    with pytest.raises(ValueError, match="no distribution exists"):
        fam.TweedieFamily(0.5)
    with pytest.raises(TypeError, match="must be numeric"):
        fam.TweedieFamily("a")
    with pytest.raises(ValueError, match="strictly positive"):
        fam.NegativeBinomialFamily(0)
    with pytest.raises(ValueError, match="family must be"):
        fam.get_family("none")
    with pytest.raises(ValueError, match="link must be"):
        lk.get_link("none", fam.NormalFamily())
    with pytest.raises(NotImplementedError):
        fam.HyperbolicSecantFamily().log_likelihood(np.ones(2), np.ones(2))
