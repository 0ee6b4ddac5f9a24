"""Leading eigenvectors of a symmetric matrix: tridiagonal form, Sturm counts, inverse iteration."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal, and the unit Householder vectors (one for each column but two) that lead there."""
    a = np.array(a, np.float64)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        # scaled, so that no square of a small column vanishes
        size = np.abs(v).max()
        if size == 0:
            reflectors.append(np.zeros(n - k - 1))
            continue
        v /= size
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        reflectors.append(v)
        sub = a[k + 1 :, k + 1 :]
        p = sub @ v
        w = p - (v @ p) * v
        sub -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def restored(vectors: np.ndarray, reflectors: list[np.ndarray]) -> np.ndarray:
    """Eigenvectors (columns) of the matrix from those of its tridiagonal form."""
    out = vectors.copy()
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        out[k + 1 :] -= 2 * np.outer(v, v @ out[k + 1 :])
    return out


def above(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Eigenvalues greater than each x: the positive terms of the Sturm sequence."""
    tiny = np.finfo(float).tiny * max(1.0, float(np.max(e * e, initial=0.0)))
    q = d[0] - x
    count = (q > 0).astype(np.int64)
    for k in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[k] - x - e[k - 1] * e[k - 1] / q
        count += q > 0
    return count


def leading(d: np.ndarray, e: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, each bisected to the last bit."""
    r = np.concatenate([np.abs(e), [0.0]]) + np.concatenate([[0.0], np.abs(e)])
    low, high = np.full(most, (d - r).min()), np.full(most, (d + r).max())
    span = high - low
    low, high = low - 1e-12 * span - np.finfo(float).tiny, high + 1e-12 * span + np.finfo(float).tiny
    k = np.arange(most)
    for _ in range(120):
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high)).all():
            break
        more = above(d, e, mid) > k  # the k-th largest lies above
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    return low + (high - low) / 2


def _solver(d: np.ndarray, e: np.ndarray, shift: float, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) x = b by elimination with row interchanges; zero pivots become ``least``."""
    n = len(d)
    u0, u1, u2, factor, swap = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, bool)
    a, b = d[0] - shift, e[0] if n > 1 else 0.0  # the current row: diagonal, one to its right
    for k in range(n - 1):
        below, diag, right = e[k], d[k + 1] - shift, e[k + 1] if k + 2 < n else 0.0
        if abs(below) > abs(a):
            swap[k] = True
            u0[k], u1[k], u2[k] = below, diag, right
            factor[k] = a / below
            a, b = b - factor[k] * diag, -factor[k] * right
        else:
            a = a if abs(a) > least else least
            u0[k], u1[k] = a, b
            factor[k] = below / a
            a, b = diag - factor[k] * b, right
    u0[n - 1] = a if abs(a) > least else least

    def solve(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for k in range(n - 1):
            if swap[k]:
                x[k], x[k + 1] = x[k + 1], x[k] - factor[k] * x[k + 1]
            else:
                x[k + 1] -= factor[k] * x[k]
        for k in range(n - 1, -1, -1):
            x[k] = (x[k] - (u1[k] * x[k + 1] if k + 1 < n else 0.0) - (u2[k] * x[k + 2] if k + 2 < n else 0.0)) / u0[k]
        return x / np.abs(x).max()

    return solve


def vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix; those of a cluster of close values are made orthogonal to each other."""
    n = len(d)
    norm = float(np.max(np.abs(d) + np.concatenate([np.abs(e), [0.0]]) + np.concatenate([[0.0], np.abs(e)]))) or 1.0
    eps = np.finfo(float).eps
    out = np.zeros((n, len(values)))
    rng = np.random.default_rng(7)
    first = 0  # of the current cluster
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            first = k
        # equal values get shifts a few bits apart
        shift = value if k == first else min(value, shift_before - 4 * eps * norm)
        solve = _solver(d, e, shift, eps * norm)
        x = rng.uniform(-1, 1, n)
        for _ in range(5):
            x = solve(x)
            for _ in range(2):
                x -= out[:, first:k] @ (out[:, first:k].T @ x)
            size = np.sqrt(x @ x)
            x = x / size if size > 1e-8 else rng.uniform(-1, 1, n)
        out[:, k] = x
        shift_before = shift
    return out


def components(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit eigenvectors in columns."""
    most = min(most, len(a))
    scale = float(np.abs(a).max(initial=0.0))
    if scale == 0 or most == 0:
        return np.zeros(most), np.eye(len(a))[:, :most]
    d, e, reflectors = tridiagonal(a / scale)
    values = leading(d, e, most)
    found = restored(vectors(d, e, values), reflectors)
    # a last correction of what rounding leaves: the vectors orthonormal, the values their quotients
    for k in range(most):
        for _ in range(2):
            found[:, k] -= found[:, :k] @ (found[:, :k].T @ found[:, k])
        found[:, k] /= np.sqrt(found[:, k] @ found[:, k])
    quotients = np.einsum("ij,ij->j", found, (a / scale) @ found)
    order = np.argsort(-quotients, kind="stable")
    return quotients[order] * scale, found[:, order]
