"""Losses by value, slope and curvature in the prediction f.

Where a loss has kinks the curvature is that of a quadratic that lies above it and touches it at f
(iteratively reweighted least squares), so a full step cannot raise the objective.
"""

from __future__ import annotations

import numpy as np

KINK = 1e-3


def _abs_curvature(u: np.ndarray) -> np.ndarray:
    return 0.5 / np.maximum(np.abs(u), KINK)


def evaluate(loss: str, y: np.ndarray, f: np.ndarray, epsilon: float = 0.1):
    """(value, slope, curvature); classification losses take y in {-1, 1}."""
    r = f - y
    size = np.abs(r)
    if loss == "squared_error":
        return 0.5 * r * r, r, np.ones_like(r)
    if loss == "huber":
        inside = size <= epsilon
        value = np.where(inside, 0.5 * r * r, epsilon * size - 0.5 * epsilon**2)
        return value, np.clip(r, -epsilon, epsilon), np.where(inside, 1.0, epsilon / np.maximum(size, 1e-300))
    if loss == "epsilon_insensitive":
        value = np.maximum(0.0, size - epsilon)
        slope = np.where(size > epsilon, np.sign(r), 0.0)
        return value, slope, _abs_curvature(r - epsilon) + _abs_curvature(r + epsilon)
    if loss == "squared_epsilon_insensitive":
        u = np.maximum(0.0, size - epsilon)
        return u * u, 2 * u * np.sign(r), np.where(u > 0, 2.0, 1e-3)
    m = y * f
    if loss == "log_loss":
        p = 1.0 / (1.0 + np.exp(np.clip(m, -500, 500)))
        return np.logaddexp(0.0, -m), -y * p, np.maximum(p * (1 - p), 1e-9)
    if loss == "hinge":
        u = 1.0 - m
        return np.maximum(0.0, u), np.where(u > 0, -y, 0.0), _abs_curvature(u)
    if loss == "squared_hinge":
        u = np.maximum(0.0, 1.0 - m)
        return u * u, -2 * y * u, np.where(u > 0, 2.0, 1e-3)
    if loss == "modified_huber":
        steep = m < -1
        u = np.maximum(0.0, 1.0 - m)
        value = np.where(steep, -4 * m, u * u)
        slope = np.where(steep, -4 * y, -2 * y * u)
        curve = np.where(steep, 4.0 / np.maximum(1 - m, 1e-12), np.where(u > 0, 2.0, 1e-3))
        return value, slope, curve
    raise ValueError(f"unknown loss {loss}")
