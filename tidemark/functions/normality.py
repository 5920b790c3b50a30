"""Numeric parts of the normality tests."""

from __future__ import annotations

import math

import numpy as np

from tidemark.functions.special import normal_quantile, normal_tail

# Royston's polynomial coefficients for the Shapiro-Wilk test (fixed values,
# Applied Statistics algorithm AS R94), constant term first.
LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
SECOND_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_MEAN = [0.544, -0.39978, 0.025054, -6.714e-4]
SMALL_LOG_SD = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_LOG_SD = [-0.4803, -0.082676, 0.0030302]
SMALL_GAMMA = [-2.273, 0.459]
ERFC_LIMIT = 25.0


def _poly(coefficients: list[float], x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coefficients))


def shapiro_weights(n: int) -> np.ndarray:
    """Weights of the ordered sample; antisymmetric, squared sum one."""
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    half = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(n // 2 + n % 2 + 1, n + 1)])
    m = np.concatenate([-half[::-1], np.zeros(n % 2), half])
    ss, root = float(m @ m), 1.0 / math.sqrt(n)
    a = m / math.sqrt(ss)
    last = a[-1] + _poly(LAST_WEIGHT, root)
    if n > 5:
        second = a[-2] + _poly(SECOND_WEIGHT, root)
        left = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a = m / math.sqrt(left)
        a[-2], a[1] = second, -second
    else:
        left = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a = m / math.sqrt(left)
    a[-1], a[0] = last, -last
    return a


def shapiro_wilk(sample: np.ndarray) -> tuple[float, float]:
    """W statistic and p-value of 3 to 5000 values."""
    x = np.sort(np.asarray(sample, dtype=float))
    n = len(x)
    spread = float(((x - x.mean()) ** 2).sum())
    if spread <= 0.0 or x[0] == x[-1]:
        return 1.0, 1.0
    w = min(1.0, float(shapiro_weights(n) @ (x - np.median(x))) ** 2 / spread)
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, min(1.0, max(0.0, p))
    gap = math.log(max(1.0 - w, 1e-300))
    if n <= 11:
        gamma = _poly(SMALL_GAMMA, n)
        if gap >= gamma:
            return w, 0.0
        y, mean, sd = -math.log(gamma - gap), _poly(SMALL_MEAN, n), math.exp(_poly(SMALL_LOG_SD, n))
    else:
        logn = math.log(n)
        y, mean, sd = gap, _poly(LARGE_MEAN, logn), math.exp(_poly(LARGE_LOG_SD, logn))
    return w, normal_tail((y - mean) / sd)


def log_normal_tails(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logs of the standard normal distribution function at ``z`` and at ``-z``, elementwise."""
    z = np.asarray(z, dtype=float)
    x = np.abs(z) / math.sqrt(2.0)
    tail = 0.5 * np.fromiter(map(math.erfc, x.tolist()), float, len(x))
    with np.errstate(divide="ignore"):
        upper = np.log(tail)
    # beyond, the tail is too small for a double: its continued fraction
    far = x > ERFC_LIMIT
    if far.any():
        reach = x[far]
        fraction = reach.copy()
        for k in range(60, 0, -1):
            fraction = reach + (k / 2.0) / fraction
        with np.errstate(invalid="ignore"):
            upper[far] = -reach * reach - np.log(fraction) - 0.5 * math.log(math.pi) - math.log(2.0)
    lower = np.log1p(-tail)
    return np.where(z < 0, upper, lower), np.where(z < 0, lower, upper)


def log_normal_cdf(z: np.ndarray) -> np.ndarray:
    """log of the standard normal distribution function, elementwise."""
    return log_normal_tails(z)[0]
