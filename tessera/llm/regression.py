"""A small logistic regression, fitted on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, the last for the intercept, by damped Newton steps; columns are scaled inside.

    With one label only, or no rows, the weights give the smoothed rate of label 1.
    """
    n, k = x.shape
    out = np.zeros(k + 1)
    if n == 0 or y.min() == y.max():
        out[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)) if n else 0.0
        return out
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    a = np.c_[(x - mean) / scale, np.ones(n)]
    w, penalty = np.zeros(k + 1), np.r_[np.full(k, ridge), 1e-6]
    for _ in range(rounds):
        p = sigmoid(a @ w)
        grad = a.T @ (y - p) - penalty * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), grad)
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out[:k] = w[:k] / scale
    out[k] = w[k] - (w[:k] * mean / scale).sum()
    return out
