"""Closed-form values of the numeric helpers."""

import math

import numpy as np
import pytest

from tidemark.functions import normality, special
from tidemark.operators.bootstrap import median_ranks
from tidemark.operators.clustering import elbow
from tidemark.operators.hypothesis import _exact_u_tail
from tidemark.operators.kendall import weighted_inversions


def test_tails_have_their_textbook_values():
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert special.chi2_tail(4.0, 2) == pytest.approx(math.exp(-2.0), abs=1e-14)
    assert special.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert special.t_two_sided(2.228138851964939, 10) == pytest.approx(0.05, abs=1e-9)
    # With two numerator degrees of freedom the F tail is a power.
    assert special.f_tail(3.0, 2, 20) == pytest.approx((1 + 2 * 3.0 / 20) ** -10, abs=1e-12)
    assert special.normal_tail(1.959963984540054) == pytest.approx(0.025, abs=1e-12)


def test_quantiles_invert_the_tails():
    for p in (0.6, 0.9, 0.975, 0.999):
        assert special.normal_tail(special.normal_quantile(p)) == pytest.approx(1 - p, abs=1e-12)
        assert special.t_two_sided(special.t_quantile(p, 7), 7) / 2 == pytest.approx(1 - p, abs=1e-12)
        assert special.chi2_tail(special.chi2_quantile(p, 5), 5) == pytest.approx(1 - p, abs=1e-12)


def test_log_normal_cdf_in_both_tails():
    z = np.array([-10.0, -4.0, -3.5355, -1.0, 0.0, 1.0, 3.6, 6.0])
    want = [math.log(special.normal_tail(-v)) for v in z]
    assert np.allclose(normality.log_normal_cdf(z), want, rtol=1e-10, atol=1e-15)


def test_shapiro_wilk_known_sample():
    w, p = normality.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert w == pytest.approx(0.79, abs=0.005)
    assert p == pytest.approx(0.0067, abs=2e-4)


def test_shapiro_wilk_tells_normal_from_skewed():
    rng = np.random.default_rng(1)
    assert normality.shapiro_wilk(rng.normal(size=500))[1] > 0.05
    assert normality.shapiro_wilk(rng.exponential(size=500))[1] < 1e-6
    assert normality.shapiro_wilk(np.ones(20)) == (1.0, 1.0)


def test_inversions_equal_pair_counting():
    rng = np.random.default_rng(2)
    for _ in range(20):
        ranks, weights = rng.integers(0, 12, 60), rng.integers(1, 4, 60)
        want = sum(
            weights[i] * weights[j] for i in range(60) for j in range(i + 1, 60) if ranks[i] > ranks[j]
        )
        assert weighted_inversions(ranks, weights) == want


def test_exact_u_distribution():
    # Two samples of three: 20 orderings, U counts 1 1 2 3 3 3 3 2 1 1.
    assert _exact_u_tail(9, 3, 3) == pytest.approx(1 / 20)
    assert _exact_u_tail(7, 3, 3) == pytest.approx(4 / 20)
    assert _exact_u_tail(0, 3, 5) == pytest.approx(1.0)


@pytest.mark.parametrize("n", [11, 12, 200])
def test_drawn_median_ranks_follow_real_resampling(n):
    rng = np.random.default_rng(3)
    low, high = median_ranks(n, 40_000, rng)
    drawn = (low + high) / 2
    real = np.median(rng.integers(0, n, size=(40_000, n)), axis=1)
    assert drawn.mean() == pytest.approx(real.mean(), abs=0.02 * n)
    assert drawn.std() == pytest.approx(real.std(), rel=0.05)
    assert (low <= high).all() and low.min() >= 0 and high.max() <= n - 1


def test_elbow_takes_the_largest_drop_of_gain():
    assert elbow([100.0, 40.0, 30.0, 25.0]) == 3
    assert elbow([100.0, 50.0]) == 2
    assert elbow([1000, 900, 800, 700, 600, 500, 100, 90, 80]) == 6


def test_t_tail_keeps_its_digits_at_many_degrees_of_freedom():
    for dof in (1e5, 1e6, 2e6, 1e8, 1e10, 1e12):
        assert special.t_two_sided(1.96, dof) == pytest.approx(0.0499957902964409, abs=3e-6 * 1e5 / dof + 2e-9)
    assert special.f_tail(3.0, 2, 1e10) == pytest.approx(math.exp(-3.0), rel=1e-7)


def test_t_quantiles_at_many_sizes():
    dof = np.array([1.0, 2.0, 2.0, 30.5, 999.0, 1001.0, 1e7])
    got = special.t_quantiles(0.975, dof)
    assert got == pytest.approx([special.t_quantile(0.975, float(d)) for d in dof], rel=1e-9)
