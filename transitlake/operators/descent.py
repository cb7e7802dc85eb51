"""Limited-memory quasi-Newton descent for models whose loss and slope are sums over rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimised(
    function: Callable[[np.ndarray], tuple[float, np.ndarray]], point: np.ndarray, rounds: int = 120, memory: int = 8, settled: float = 1e-7
) -> np.ndarray:
    """A point that ``function`` (value and slope) falls to, by step halving; ends once a
    round gains less than ``settled`` of the value."""
    value, slope = function(point)
    kept: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        direction, alphas = -slope, []
        for s, y, scale in reversed(kept):
            alphas.append(scale * float(s @ direction))
            direction = direction - alphas[-1] * y
        if kept:
            s, y, _ = kept[-1]
            direction = direction * float(s @ y) / float(y @ y)
        else:
            direction = direction / max(1.0, float(np.linalg.norm(slope)))
        for (s, y, scale), a in zip(kept, reversed(alphas)):
            direction = direction + s * (a - scale * float(y @ direction))
        downhill, step = float(slope @ direction), 1.0
        if downhill >= 0:  # the kept curvature misleads: start over from the slope
            kept, direction = [], -slope / max(1.0, float(np.linalg.norm(slope)))
            downhill = float(slope @ direction)
        while True:
            moved = point + step * direction
            new, new_slope = function(moved)
            if new <= value + 1e-4 * step * downhill or step < 1e-6:
                break
            step /= 2
        if new > value:
            break
        s, y = moved - point, new_slope - slope
        done = value - new <= settled * max(1.0, abs(value))
        if float(s @ y) > 1e-12:
            kept = [*kept, (s, y, 1 / float(s @ y))][-memory:]
        point, value, slope = moved, new, new_slope
        if done:
            break
    return point
