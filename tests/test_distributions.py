import math
import random

import pytest

from tarnlight.functions import distributions as d


def test_chi2_tail_known_values():
    assert d.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert d.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert d.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert d.chi2_tail(2.0, 2) == pytest.approx(math.exp(-1), abs=1e-12)


def test_correlation_p_by_t():
    # t = 2.228 with 10 degrees of freedom is the 5 % point
    t, df = 2.2281388519649385, 10
    r = t / math.sqrt(df + t * t)
    assert d.correlation_p(r, 12) == pytest.approx(0.05, abs=1e-8)
    assert d.correlation_p(None, 12) is None
    assert d.correlation_p(1.0, 12) == 0.0


def test_beta_symmetry():
    assert d.beta_i(0.3, 2, 5) == pytest.approx(1 - d.beta_i(0.7, 5, 2))
    assert d.beta_i(0.5, 1, 1) == pytest.approx(0.5)


def test_shapiro_published_example():
    # weights of eleven men, from Shapiro and Wilk's paper: W = 0.79, p < 0.01
    w, p = d.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.01)
    assert p < 0.01


def test_normality_separates():
    r = random.Random(1)
    normal = [r.gauss(0, 1) for _ in range(200)]
    assert d.shapiro(normal)[1] > 0.01
    assert d.shapiro([x**4 for x in normal])[1] < 1e-6
    assert d.shapiro([1, 1, 1]) is None
    assert d.normality_k2(1000, 0.0, 0.0) > 0.5
    assert d.normality_k2(1000, 1.0, 2.0) < 1e-10
