"""Plain solvers over rows in memory, which the distributed fit is held against."""

from __future__ import annotations

import numpy as np

from commitloom.operators.scoring import Sparse

TOLERANCE = 1e-9

def one_against_rest(x: Sparse, label: np.ndarray, inside: np.ndarray, c: int, classes: int, width: int, max_iter: int) -> tuple[list[float], list[float]]:
    """(coefficients, [intercept, a, b]) of class c, fitted to the rows ``inside`` and calibrated on the others."""
    mine = label == c
    if any(part.all() or not part.any() for part in (mine[inside], mine[~inside])):
        return [0.0] * width, [0.0] * 3
    train, n = x.taken(np.flatnonzero(inside)), np.count_nonzero(inside)
    cost = np.where(mine[inside], n / (classes * np.count_nonzero(mine[inside])), 1.0)
    w = squared_hinge(train, np.where(mine[inside], 1.0, -1.0), cost, width, max_iter)
    margin = x.taken(np.flatnonzero(~inside)).times(w[:-1]) + w[-1]
    return w[:-1].tolist(), [float(w[-1]), *platt(margin, mine[~inside])]


def squared_hinge(x: Sparse, y: np.ndarray, cost: np.ndarray, width: int, max_iter: int = 100) -> np.ndarray:
    """Coefficients, the intercept last, that minimize |w|^2 / 2 + sum of cost * max(0, 1 - y * (x w))^2.

    The intercept is a coefficient of a feature that is 1 in every row. Newton steps, each solved by conjugate
    gradients and shortened until it descends; the minimum is the only one.
    """
    forward = lambda v: x.times(v[:-1]) + v[-1]
    back = lambda r: np.append(x.back(r, width), r.sum())
    w = np.zeros(width + 1)
    margin, first = forward(w), None
    value = lambda w, slack: 0.5 * w @ w + cost @ slack**2
    slack = np.maximum(0, 1 - y * margin)
    for _ in range(max_iter):
        gradient = w - 2 * back(cost * y * slack)
        size = np.sqrt(gradient @ gradient)
        first = size if first is None else first
        if size <= TOLERANCE * first:
            break
        curve = 2 * cost * (slack > 0)
        step, left = np.zeros_like(w), -gradient
        direction, square = left.copy(), left @ left
        while np.sqrt(square) > min(0.1, np.sqrt(size / first)) * size * 0.1:
            bent = direction + back(curve * forward(direction))
            far = square / (direction @ bent)
            step += far * direction
            left -= far * bent
            square, before = left @ left, square
            direction = left + square / before * direction
        along, slope, now, t = forward(step), gradient @ step, value(w, slack), 1.0
        while t > 1e-12:
            there = np.maximum(0, 1 - y * (margin + t * along))
            if value(w + t * step, there) <= now + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        w, margin = w + t * step, margin + t * along
        slack = np.maximum(0, 1 - y * margin)
    return w


def platt(margin: np.ndarray, mine: np.ndarray, max_iter: int = 100) -> tuple[float, float]:
    """a, b of p = 1 / (1 + exp(a * margin + b)), by Newton steps, with targets softened by the classes' sizes."""
    high, low = np.count_nonzero(mine), np.count_nonzero(~mine)
    target = np.where(mine, (high + 1) / (high + 2), 1 / (low + 2))
    loss = lambda ab: (np.logaddexp(0, ab[0] * margin + ab[1]) - (1 - target) * (ab[0] * margin + ab[1])).sum()
    ab = np.array([0.0, np.log((low + 1) / (high + 1))])
    for _ in range(max_iter):
        z = np.clip(ab[0] * margin + ab[1], -500, 500)
        p = 1 / (1 + np.exp(z))
        gradient = np.array([(target - p) @ margin, (target - p).sum()])
        if np.abs(gradient).max() < 1e-10 * len(margin):
            break
        q = p * (1 - p) + 1e-12
        step = np.linalg.solve(np.array([[q @ margin**2, q @ margin], [q @ margin, q.sum()]]) + 1e-12 * np.eye(2), -gradient)
        t, now = 1.0, loss(ab)
        while t > 1e-10 and loss(ab + t * step) > now + 1e-4 * t * (gradient @ step):
            t /= 2
        if t <= 1e-10:
            break
        ab = ab + t * step
    return float(ab[0]), float(ab[1])
