"""Small linear models for the driver: dense features of a bounded sample, Newton's method or accelerated gradient descent."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _descend(x: np.ndarray, slope, l2: float, steps: int, curve: float) -> tuple[np.ndarray, float]:
    """Nesterov's method on mean loss + l2/2 |w|^2; ``slope`` gives dloss/dz, ``curve`` bounds its derivative. The intercept is free.

    Features are standardised first (and the weights taken back at the end), as rare ones would else hardly move.
    """
    n, d = x.shape
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-4)
    x = (x - mean) / scale
    v = np.ones(d, x.dtype) / np.sqrt(d)
    for _ in range(12):  # the largest eigenvalue of x'x/n
        v = x.T @ (x @ v) / n
        top = float(np.linalg.norm(v)) or 1.0
        v = v / top
    rate = 1.0 / (curve * (1.1 * top + 1.0) + l2)
    w, b, pw, pb, t = np.zeros(d, x.dtype), 0.0, np.zeros(d, x.dtype), 0.0, 1.0
    for _ in range(steps):
        g = slope(x @ w + b) / n
        nw, nb = w - rate * (x.T @ g + l2 * w), b - rate * float(g.sum())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / nt
        w, b = nw + m * (nw - pw), nb + m * (nb - pb)
        pw, pb, t = nw, nb, nt
    pw = pw / scale
    return pw, pb - float(mean @ pw)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 20) -> tuple[np.ndarray, float]:
    """Weights and intercept for y in {0, 1}: mean loss + l2/2 |w|^2 over standardised features, by Newton's method; the intercept is free."""
    n, d = x.shape
    y = y.astype(np.float32)
    k = float(y.sum())
    if k in (0.0, float(n)):  # nothing to tell apart
        return np.zeros(d, np.float32), float(np.log((k + 0.5) / (n - k + 0.5)))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-4)
    z = np.hstack([(x - mean) / scale, np.ones((n, 1), x.dtype)]).astype(np.float32)
    reg = np.append(np.full(d, l2), 1e-9)
    w = np.append(np.zeros(d), np.log(k / (n - k)))

    def loss(v: np.ndarray) -> float:
        m = (z @ v.astype(np.float32)).astype(np.float64)
        return float(np.mean(np.logaddexp(0, m) - y * m) + (reg * v * v).sum() / 2)

    best = loss(w)
    for _ in range(steps):
        p = sigmoid(z @ w.astype(np.float32)).astype(np.float32)
        slope = (z.T @ (p - y)).astype(np.float64) / n + reg * w
        curve = (z.T @ (z * (p * (1 - p))[:, None])).astype(np.float64) / n + np.diag(reg + 1e-9)
        step = np.linalg.solve(curve, slope)
        t = 1.0
        while (got := loss(w - t * step)) > best and t > 1e-4:
            t /= 2
        if got >= best - 1e-7:
            break
        w, best = w - t * step, got
    v = (w[:-1] / scale).astype(np.float32)
    return v, float(w[-1] - mean @ v)


def svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 150) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss; y in {0, 1}, the classes weigh the same."""
    s = np.where(y > 0, 1, -1).astype(x.dtype)
    n = len(y)
    c = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y <= 0).sum()))).astype(x.dtype)
    return _descend(x, lambda z: -2 * c * s * np.maximum(0, 1 - s * z), l2, steps, 2 * float(c.max()))
