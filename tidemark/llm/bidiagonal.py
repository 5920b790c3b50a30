"""Singular values and right singular vectors of a small square factor.

Householder reflections make the factor bidiagonal, dqds finds its singular values to high
relative accuracy, and a twisted factorisation gives the direction of each; directions of
values that lie close together come from their common subspace.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(float).eps)
# Values whose squares differ by less than this share are treated together.
CLOSE = 1e-3


def bidiagonalise(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with factor = U B V'."""
    a = np.array(factor, dtype=float)
    n = a.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        w = x.copy()
        norm = math.sqrt(float(w @ w))
        if norm == 0.0:
            return w, 0.0
        w[0] += math.copysign(norm, w[0])
        return w, 2.0 / float(w @ w)

    for k in range(n):
        w, scale = reflector(a[k:, k])
        a[k:, k:] -= scale * np.outer(w, w @ a[k:, k:])
        if k < n - 2:
            w, scale = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= scale * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= scale * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _sweep(q: list[float], e: list[float], lo: int, hi: int, tau: float):
    """One dqds transform of a block, or None where the shift is too large."""
    new_q, new_e = [], []
    d = q[lo] - tau
    for k in range(lo, hi):
        if d < 0.0:
            return None
        total = d + e[k]
        ratio = q[k + 1] / total if total > 0.0 else 0.0
        new_q.append(total)
        new_e.append(e[k] * ratio)
        d = (d * ratio if total > 0.0 else q[k + 1]) - tau
    if d < 0.0 or not math.isfinite(d):
        return None
    return [*new_q, d], new_e


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """dqds: the singular values of a bidiagonal matrix, falling."""
    n = len(diagonal)
    scale = float(max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0)))
    if scale == 0.0:
        return np.zeros(n)
    q = [float(x) ** 2 for x in diagonal / scale]
    e = [float(x) ** 2 for x in above / scale]
    found: list[float] = []
    stack, sweeps = [(0, n - 1, 0.0)], 0
    while stack:
        lo, hi, sigma = stack.pop()
        while lo <= hi:
            if lo == hi:
                found.append(sigma + q[lo])
                break
            if e[hi - 1] <= EPS * EPS * (sigma + q[hi]):
                found.append(sigma + q[hi])
                hi -= 1
                continue
            cut = next((k for k in range(hi - 2, lo - 1, -1) if e[k] <= EPS * EPS * max(sigma, min(q[k], q[k + 1]))), None)
            if cut is not None:
                stack.append((lo, cut, sigma))
                lo = cut + 1
                continue
            a, b, c = q[hi - 1], e[hi - 1], q[hi]
            large = ((a + b + c) + math.sqrt((a - c) ** 2 + b * b + 2 * b * (a + c))) / 2
            small = a * (c / large)
            if hi - lo == 1:
                found += [sigma + large, sigma + small]
                break
            if 1.5 * q[lo] < q[hi]:
                q[lo : hi + 1] = q[lo : hi + 1][::-1]
                e[lo:hi] = e[lo:hi][::-1]
                a, b, c = q[hi - 1], e[hi - 1], q[hi]
                small = a * (c / (((a + b + c) + math.sqrt((a - c) ** 2 + b * b + 2 * b * (a + c))) / 2))
            done = None
            for share in (1.0 - 4 * EPS, 0.9, 0.5, 0.1, 0.0):
                tau = small * share
                done = _sweep(q, e, lo, hi, tau)
                if done is not None:
                    break
            q[lo : hi + 1], e[lo:hi] = done
            sigma += tau
            sweeps += 1
            if sweeps > 1000 * n:
                raise ArithmeticError("dqds does not settle")
    return scale * np.sqrt(np.sort(np.array(found))[::-1])


def twisted(diagonal: np.ndarray, above: np.ndarray, square: float) -> np.ndarray:
    """The unit eigenvector of B'B for the eigenvalue ``square`` from the best twisted factorisation."""
    n = len(diagonal)
    tiny = EPS * EPS * float(np.max(diagonal * diagonal))
    d = [max(float(x) ** 2, tiny) for x in diagonal]
    low = [float(b) / math.copysign(math.sqrt(dd), float(a)) for a, b, dd in zip(diagonal, above, d)]
    s, plus = [-square], []
    for k in range(n - 1):
        pivot = d[k] + s[k]
        pivot = pivot if abs(pivot) > tiny else tiny
        plus.append(d[k] * low[k] / pivot)
        s.append(plus[k] * low[k] * s[k] - square)
    p, minus = [0.0] * n, [0.0] * n
    p[n - 1] = d[n - 1] - square
    for k in range(n - 2, -1, -1):
        pivot = d[k] * low[k] * low[k] + p[k + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        minus[k] = low[k] * (d[k] / pivot)
        p[k] = p[k + 1] * (d[k] / pivot) - square
    twist = min(range(n), key=lambda k: abs(s[k] + p[k] + square))
    z = np.zeros(n)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -plus[k] * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -minus[k] * z[k]
    return z / np.linalg.norm(z)


def _subspace(band: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors of B'B for neighbouring eigenvalues, by steps on their common subspace."""
    n, m = len(band), len(squares)
    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(m)).standard_normal((n, m)))[0]
    gram = band.T @ band
    middle = float(squares.mean()) * (1.0 + 1e-10)
    shifted = gram - middle * np.eye(n)
    for _ in range(6):
        basis = np.linalg.qr(np.linalg.solve(shifted, basis))[0]
    moved = band @ basis
    _, turn = np.linalg.eigh(moved.T @ moved)
    return basis @ turn[:, ::-1]


def directions(factor: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(all singular values, the first ``count`` right singular vectors of non-zero ones as columns)."""
    diagonal, above, v = bidiagonalise(factor)
    values = singular_values(diagonal, above)
    rank = int((values > len(values) * EPS * values[0]).sum())
    wanted = min(count, rank)
    scale = values[0] or 1.0
    squares = (values / scale) ** 2
    band = (np.diag(diagonal) + np.diag(above, 1)) / scale
    columns, at = [], 0
    while at < wanted:
        end = at + 1
        while end < rank and squares[end - 1] - squares[end] < CLOSE * squares[end - 1]:
            end += 1
        if end - at == 1:
            columns.append(twisted(diagonal / scale, above / scale, squares[at])[:, None])
        else:
            columns.append(_subspace(band, squares[at:end]))
        at = end
    found = np.hstack(columns)[:, :wanted] if columns else np.zeros((len(values), 0))
    return values, v @ found
