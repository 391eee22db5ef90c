"""Newton's method without a matrix: steps from Krylov subspaces, shortened until the residual falls."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np


@dataclasses.dataclass(frozen=True)
class Solution:
    x: np.ndarray
    #: Largest absolute entry of what is left, and whether it is within the tolerance.
    residual: float
    settled: bool
    steps: int


def krylov_step(product: Callable[[np.ndarray], np.ndarray], goal: np.ndarray, size: int, share: float) -> np.ndarray:
    """The least-squares solution of product(x) = goal in the Krylov space of ``goal`` (GMRES), of at most ``size`` dimensions,
    or as few as leave ``share`` of the goal."""
    length = np.linalg.norm(goal)
    basis, heights = [goal / length], np.zeros((size + 1, size))
    weights = np.zeros(0)
    for k in range(size):
        v = product(basis[k])
        for i, q in enumerate(basis):
            heights[i, k] = q @ v
            v = v - heights[i, k] * q
        heights[k + 1, k] = np.linalg.norm(v)
        first = np.r_[length, np.zeros(k + 1)]
        part = heights[: k + 2, : k + 1]
        weights = np.linalg.lstsq(part, first, rcond=None)[0]
        if np.linalg.norm(part @ weights - first) <= share * length or heights[k + 1, k] < 1e-14 * length:
            break
        basis.append(v / heights[k + 1, k])
    return np.array(basis[: len(weights)]).T @ weights


def newton_krylov(residual: Callable[[np.ndarray], np.ndarray], start: np.ndarray, low: float, high: float, tolerance: float, steps: int = 40, size: int = 40) -> Solution:
    """Where ``residual`` vanishes, within bounds. Derivatives are differences of residuals along a direction. A step is
    halved until the residual falls by a part of what the step promises; if no step does, the search ends."""
    x = np.clip(start, low, high)
    left = residual(x)
    for step in range(steps):
        worst = float(np.abs(left).max(initial=0.0))
        if worst <= tolerance:
            return Solution(x, worst, True, step)
        norm = np.linalg.norm(left)

        def along(v: np.ndarray, x=x, left=left) -> np.ndarray:
            h = 1e-7 * max(1.0, np.linalg.norm(x)) / max(np.linalg.norm(v), 1e-300)
            h = h if ((x + h * v <= high) & (x + h * v >= low)).all() else -h  # away from a bound where one side meets it
            return (residual(np.clip(x + h * v, low, high)) - left) / h

        move = krylov_step(along, -left, min(size, len(x)), min(0.1, norm))
        scale = 1.0
        while scale > 1e-8:
            there = np.clip(x + scale * move, low, high)
            new = residual(there)
            if np.isfinite(new).all() and np.linalg.norm(new) <= (1 - 1e-4 * scale) * norm:
                break
            scale /= 2
        else:
            return Solution(x, worst, False, step)
        x, left = there, new
    worst = float(np.abs(left).max(initial=0.0))
    return Solution(x, worst, worst <= tolerance, steps)
