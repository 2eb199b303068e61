"""Linear support vector machines on sparse rows by dual coordinate descent, and a sigmoid for their margins."""

from __future__ import annotations

import numpy as np

Sparse = tuple[np.ndarray, np.ndarray]


def train_hinge(rows: list[Sparse], signs: np.ndarray, dim: int, cost: float = 1.0, epochs: int = 12, balanced: bool = True, seed: int = 7) -> np.ndarray:
    """Weights of length dim + 1 (the last one is the bias) for the L2-regularised hinge loss.

    Each step solves one dual variable exactly inside its box [0, C]; with ``balanced`` the two classes' boxes
    weigh the same in total.
    """
    weights = np.zeros(dim + 1)
    n = len(rows)
    if not n:
        return weights
    positive = max(1, int((signs > 0).sum()))
    negative = max(1, n - positive)
    box = np.where(signs > 0, n / (2 * positive), n / (2 * negative)) * cost if balanced else np.full(n, cost)
    diagonal = np.array([float(v @ v) + 1.0 for _, v in rows])
    alpha, rng = np.zeros(n), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            idx, val = rows[i]
            gradient = signs[i] * (weights[idx] @ val + weights[dim]) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), box[i])
            change = new - alpha[i]
            if change:
                alpha[i] = new
                weights[idx] += change * signs[i] * val
                weights[dim] += change * signs[i]
                moved = max(moved, abs(change))
        if moved < 1e-3:
            break
    return weights


def margin(row: Sparse, weights: np.ndarray) -> float:
    """The signed distance of one row, up to the weights' length."""
    return float(weights[row[0]] @ row[1] + weights[-1])


def fit_sigmoid(margins: np.ndarray, signs: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(slope, offset) of the logistic curve over margins, by Newton steps on smoothed targets."""
    positive, negative = int((signs > 0).sum()), int((signs <= 0).sum())
    target = np.where(signs > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    slope, offset = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[h @ margins**2 + 1e-6, h @ margins], [h @ margins, h.sum() + 1e-6]])
        delta = np.linalg.solve(hess, np.array([g @ margins, g.sum()]))
        slope, offset = slope - float(np.clip(delta[0], -2, 2)), offset - float(np.clip(delta[1], -2, 2))
        if np.abs(delta).max() < 1e-8:
            break
    return max(slope, 1e-3), offset


def sigmoid(x: float) -> float:
    """The logistic function without overflow."""
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))
