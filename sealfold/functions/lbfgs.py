"""Limited-memory BFGS with a strong Wolfe line search, for smooth functions whose evaluation is a distributed job."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np

Function = Callable[[np.ndarray], tuple[float, np.ndarray]]
_SUFFICIENT, _CURVATURE = 1e-4, 0.9


def _line_search(f: Function, x: np.ndarray, value: float, gradient: np.ndarray, direction: np.ndarray, step: float) -> tuple[float, float, np.ndarray] | None:
    """A step that meets the strong Wolfe conditions, by bracketing and bisection with cubic steps; None if there is none."""
    slope = float(gradient @ direction)
    low, low_value, low_slope = 0.0, value, slope
    high: float | None = None
    for _ in range(30):
        at, g = f(x + step * direction)
        here = float(g @ direction)
        if not np.isfinite(at) or at > value + _SUFFICIENT * step * slope or at >= low_value and low > 0:
            high = step
        elif abs(here) <= -_CURVATURE * slope:
            return step, at, g
        else:
            if here * ((high if high is not None else np.inf) - low) >= 0 and here > 0:
                high = low
            low, low_value, low_slope = step, at, here
        if high is None:
            step *= 2
            continue
        # The minimum of the parabola through low, if it lies well inside; else the middle.
        width = high - low
        curve = 2 * (at - low_value - low_slope * (step - low)) / (step - low) ** 2 if step != low and np.isfinite(at) else 0.0
        guess = low - low_slope / curve if curve > 0 else low + width / 2
        inside = min(low, high) + 0.1 * abs(width) <= guess <= max(low, high) - 0.1 * abs(width)
        step = guess if inside else low + width / 2
        if abs(width) < 1e-12 * max(1.0, abs(low)):
            break
    if low > 0:
        at, g = f(x + low * direction)
        return low, at, g
    return None


def minimize(f: Function, start: np.ndarray, max_iterations: int = 100, tolerance: float = 1e-6, memory: int = 10) -> np.ndarray:
    """The point where value or gradient no longer changes by more than the tolerance, relative to their size."""
    x = np.array(start, np.float64)
    value, gradient = f(x)
    pairs: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=memory)
    for _ in range(max_iterations):
        if np.linalg.norm(gradient) <= tolerance * max(1.0, abs(value)) * 1e-2:
            break
        q, kept = gradient.copy(), []
        for s, y, r in reversed(pairs):
            a = r * (s @ q)
            kept.append(a)
            q -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(pairs, reversed(kept), strict=True):
            q += (a - r * (y @ q)) * s
        direction = -q
        if gradient @ direction >= 0:
            pairs.clear()
            direction = -gradient
        found = _line_search(f, x, value, gradient, direction, 1.0 if pairs else min(1.0, 1.0 / max(np.linalg.norm(gradient), 1e-12)))
        if found is None:
            break
        step, new_value, new_gradient = found
        s, y = step * direction, new_gradient - gradient
        if s @ y > 1e-14 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs.append((s, y, 1.0 / (s @ y)))
        change = abs(value - new_value)
        x, value, gradient = x + s, new_value, new_gradient
        if change <= tolerance * 1e-4 * max(1.0, abs(value)) and np.linalg.norm(gradient) <= tolerance * max(1.0, abs(value)):
            break
    return x
