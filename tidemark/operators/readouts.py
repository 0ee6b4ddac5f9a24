"""Linear readouts of one series: ridge, lasso, elastic net and evidence-weighted, all from the Gram matrix of centred columns."""

from __future__ import annotations

import numpy as np


def fitted(kind: str, x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and constant; ``alpha`` weighs the penalty (bayes finds its own)."""
    mx, my = x.mean(0), y.mean()
    z, t = x - mx, y - my
    gram, moment, n = z.T @ z, z.T @ t, len(y)
    if kind == "ridge":
        w = np.linalg.solve(gram + alpha * np.eye(len(gram)), moment)
    elif kind == "lasso":
        w = descended(gram / n, moment / n, alpha, 0.0)
    elif kind == "elastic":
        w = descended(gram / n, moment / n, alpha / 2, alpha / 2)
    elif kind == "bayes":
        w = evidence(gram, moment, float(t @ t), n)
    else:
        raise ValueError(f"unknown readout: {kind}")
    return w, float(my - mx @ w)


KINDS = ("ridge", "lasso", "elastic", "bayes")


def descended(gram: np.ndarray, moment: np.ndarray, absolute: float, square: float, rounds: int = 5_000, tolerance: float = 1e-10) -> np.ndarray:
    """Least of w'Gw / 2 - m'w + absolute |w| + square |w|^2 / 2, one weight after another.

    After each round over all weights, those that are not zero are moved until
    they rest.
    """
    w, size = np.zeros(len(moment)), np.diag(gram).copy()
    slope = moment.copy()  # moment - gram @ w
    every = np.flatnonzero(size > 1e-300).tolist()

    def turn(which: list[int]) -> float:
        nonlocal slope
        moved = 0.0
        for j in which:
            free = slope[j] + size[j] * w[j]
            new = (free - absolute if free > absolute else free + absolute if free < -absolute else 0.0) / (size[j] + square)
            if new != w[j]:
                slope -= gram[j] * (new - w[j])
                moved = max(moved, abs(new - w[j]) * size[j])
                w[j] = new
        return moved

    least = tolerance * max(float(np.abs(moment).max(initial=0.0)), 1e-300)
    left = rounds
    while left > 0 and turn(every) > least:
        left -= 1
        some = np.flatnonzero(w).tolist()
        while left > 0 and turn(some) > least:
            left -= 1
    return w


def evidence(gram: np.ndarray, moment: np.ndarray, square: float, n: int, rounds: int = 300, tolerance: float = 1e-6) -> np.ndarray:
    """Posterior mean of weights with one Gaussian prior, whose precision and that of the noise make the data most likely (flat hyperpriors of 1e-6)."""
    values, vectors = np.linalg.eigh(gram)
    values, rotated = np.maximum(values, 0.0), vectors.T @ moment
    noise, prior, hyper = n / max(square, 1e-12), 1.0, 1e-6
    w = np.zeros(len(moment))
    for _ in range(rounds):
        coefficients = noise * rotated / (noise * values + prior)
        rest = max(square - 2 * coefficients @ rotated + (values * coefficients) @ coefficients, 0.0)
        known = (noise * values / (noise * values + prior)).sum()
        noise, prior = (n - known + 2 * hyper) / (rest + 2 * hyper), (known + 2 * hyper) / (coefficients @ coefficients + 2 * hyper)
        new = vectors @ coefficients
        if np.abs(new - w).sum() < tolerance * 1e-3:
            return new
        w = new
    return w


def steepness(target: np.ndarray, raw: np.ndarray, z: np.ndarray, start: list[tuple[float, float]], rounds: int = 14) -> tuple[float, float]:
    """(a, b) within 0.01..20 and -5..5 of the least mean |target - raw / (1 + exp(a (z - b)))|: a grid that closes in around its best points.

    ``start``: points that are tried too, so the loss is never above theirs.
    """
    a, b = (m.ravel() for m in np.meshgrid(np.geomspace(0.01, 20.0, 33), np.linspace(-5.0, 5.0, 41)))
    a, b = np.append(a, [s for s, _ in start]), np.append(b, [c for _, c in start])

    def loss(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.abs(target - raw / (1 + np.exp(np.clip(a[:, None] * (z - b[:, None]), -50, 50)))).mean(1)

    losses = loss(a, b)
    best = np.argsort(losses, kind="stable")[:6]  # the loss has several hollows
    points = [(float(losses[i]), float(a[i]), float(b[i])) for i in best]
    ratio, step = np.log(2000.0) / 32, 0.25
    for _ in range(rounds):
        closer = []
        for value, a0, b0 in points:
            p, q = (m.ravel() for m in np.meshgrid(np.clip(a0 * np.exp(ratio * np.linspace(-1, 1, 7)), 0.01, 20.0), np.clip(b0 + step * np.linspace(-1, 1, 7), -5.0, 5.0)))
            near = loss(p, q)
            i = int(np.argmin(near))
            closer.append(min((value, a0, b0), (float(near[i]), float(p[i]), float(q[i]))))
        points, ratio, step = closer, ratio / 2, step / 2
    return min(points)[1:]
