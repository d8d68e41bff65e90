"""Small learners over dense NumPy matrices: they see a bounded sample, on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(gradient, d: int, step: float, rounds: int) -> np.ndarray:
    """Nesterov's accelerated gradient from zero."""
    w = v = np.zeros(d, np.float32)
    for i in range(rounds):
        w2 = (v - step * gradient(v)).astype(np.float32)  # as the matrix: a product never copies it into another type
        v = w2 + np.float32(i / (i + 3)) * (w2 - w)
        w = w2
    return w


def _with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), x.dtype)])


def _largest(x: np.ndarray) -> float:
    """The largest eigenvalue of x'x, by the power method."""
    u = np.full(x.shape[1], 1 / np.sqrt(x.shape[1]), x.dtype)
    for _ in range(15):
        u = x.T @ (x @ u)
        n = np.linalg.norm(u)
        if not n:
            return 1.0
        u /= n
    return float(n)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 150) -> np.ndarray:
    """Weights (the last one the bias) of l2-regularised logistic regression; labels 0 and 1."""
    x, y = _with_bias(np.asarray(x, np.float32)), np.asarray(y, np.float32)
    reg = np.full(x.shape[1], l2, np.float32)
    reg[-1] = 1e-3
    return _descend(lambda w: x.T @ (sigmoid(x @ w) - y) + reg * w, x.shape[1], 1 / (0.25 * 1.1 * _largest(x) + l2), rounds)


def linear_svm(x: np.ndarray, y: np.ndarray, l2: float = 0.01, rounds: int = 150) -> np.ndarray:
    """Weights (the last one the bias) of a linear support vector machine with squared hinge loss; labels -1 and 1."""
    x, y = _with_bias(np.asarray(x, np.float32)), np.asarray(y, np.float32)
    n = len(x)
    reg = np.full(x.shape[1], l2, np.float32)
    reg[-1] = 1e-4

    def gradient(w: np.ndarray) -> np.ndarray:
        short = np.maximum(0, 1 - y * (x @ w))
        return -2 * (x.T @ (y * short)) / n + reg * w

    return _descend(gradient, x.shape[1], 1 / (2 * 1.1 * _largest(x) / n + l2), rounds)


def decision(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def folds(n: int, k: int) -> np.ndarray:
    """The fold of each row: by position, so that a rerun has the same."""
    return np.arange(n) % k
