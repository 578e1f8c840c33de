"""A small linear support vector machine: squared hinge loss by accelerated gradient steps on a bounded matrix."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, reg: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and offset for rows `x` with labels `y` in {-1, 1}; rows count by `weight`. Deterministic."""
    n, d = x.shape
    c = np.full(n, 1.0 / n) if weight is None else weight / weight.sum()
    w, b = np.zeros(d), 0.0
    pw, pb = w.copy(), b
    # The loss is at most as steep as its largest row allows; the step follows from that.
    rate = 1.0 / (2.0 * (float((c * (np.einsum("ij,ij->i", x, x) + 1.0)).sum()) + reg))
    for k in range(steps):
        m = (k - 1) / (k + 2) if k else 0.0
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        slack = np.maximum(0.0, 1.0 - y * (x @ vw + vb))
        pull = c * slack * y
        pw, pb = w, b
        w = vw + 2 * rate * (x.T @ pull - reg * vw)
        b = vb + 2 * rate * float(pull.sum())
    return w, b


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to probabilities (y in {0, 1}), by damped Newton steps."""
    if len(set(y.tolist())) < 2:
        return 2.0, 0.0
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y > 0, hi, lo)
    a, c = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margins + c)
        g = np.array([((p - t) * margins).sum(), (p - t).sum()])
        s = p * (1 - p) + 1e-12
        h = np.array([[(s * margins**2).sum() + 1e-6, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, c = a - 0.5 * step[0], c - 0.5 * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(c)
