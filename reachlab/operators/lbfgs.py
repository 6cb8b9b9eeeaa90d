"""Limited-memory BFGS with a strong Wolfe line search, as the optimiser behind MLlib's fits does it.

The same steps in the same order: two-loop recursion over the last HISTORY steps, bracketing
and cubic zoom of the line search, a reset of the history at a failed search, and the same rules
for the end. Only the function's value and gradient are asked of the caller.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np

HISTORY = 10
SEARCHES = 10              # steps of a line search, and of its zoom
SUFFICIENT, CURVATURE = 1e-4, 0.9
VALUES_KEPT = 20           # the last values that must all lie within the tolerance
LEAST_GRADIENT = 1e-8

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


class SearchFailed(ArithmeticError):
    """No step along this direction."""


def _direction(gradient: np.ndarray, history: deque) -> np.ndarray:
    """Minus the approximate inverse Hessian times the gradient; ``history`` has (step, change of gradient), the last first."""
    out, kept = gradient.copy(), []
    for step, change in history:
        rho = step @ change
        a = step @ out / rho
        if not math.isfinite(a):
            raise SearchFailed("the history holds no curvature")
        kept.append((a, rho))
        out -= a * change
    if history:
        step, change = history[0]
        scale = step @ change / (change @ change)
        if not scale >= 0:
            raise SearchFailed("the last step has no positive curvature")
        out *= scale
    for (step, change), (a, rho) in zip(reversed(history), reversed(kept)):
        out += (a - change @ out / rho) * step
    return -out


def _between(low: tuple, high: tuple) -> float:
    """The least point of the cubic through two (t, slope, value), kept off both ends."""
    (t0, d0, f0), (t1, d1, f1) = (low, high) if low[0] <= high[0] else (high, low)
    a = d0 + d1 - 3 * (f0 - f1) / (t0 - t1)
    b = a * a - d0 * d1
    b = math.sqrt(b) if b >= 0 else math.nan
    bottom = d1 - d0 + 2 * b
    t = t1 - (t1 - t0) * (d1 + b - a) / bottom if bottom else math.nan
    least, most = t0 + 0.1 * (t1 - t0), t0 + 0.9 * (t1 - t0)
    return least if t < least else most if t > most else t


def _step(along: Callable[[float], tuple[float, float]], value: float, slope: float, t: float) -> float:
    """A step that satisfies the strong Wolfe conditions; ``along(t)`` is (value, slope)."""
    def at(t):
        f, d = along(t)
        return t, d, f

    def zoom(low, high):
        for _ in range(SEARCHES):
            c = at(_between(low, high))
            if c[2] > value + SUFFICIENT * c[0] * slope or c[2] >= low[2]:
                high = c
            else:
                if abs(c[1]) <= CURVATURE * abs(slope):
                    return c[0]
                if c[1] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise SearchFailed("zoom")

    if slope > 0:
        raise SearchFailed("no descent")
    low = 0.0, slope, value
    for i in range(SEARCHES):
        c = at(t)
        if not math.isfinite(c[2]):
            t /= 2
            continue
        if c[2] > value + SUFFICIENT * t * slope or (c[2] >= low[2] and i > 0):
            return zoom(low, c)
        if abs(c[1]) <= CURVATURE * abs(slope):
            return t
        if c[1] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise SearchFailed("no bracket")


def minimise(objective: Objective, start: np.ndarray, max_iter: int, tolerance: float = 1e-6) -> tuple[np.ndarray, int]:
    """The point where ``objective`` ends to fall, and the steps taken."""
    x, last = np.array(start, dtype=float), {}

    def seen(x):
        if "x" not in last or not np.array_equal(last["x"], x):
            last["f"], last["g"] = objective(x)
            last["x"] = x
        return last["f"], last["g"]

    value, gradient = seen(x)
    first, values, history, failed, steps = value, deque([math.inf], VALUES_KEPT), deque(maxlen=HISTORY), False, 0
    while steps < max_iter:
        if len(values) > 1 and abs(value - max(values)) <= tolerance * first:
            break
        if np.linalg.norm(gradient) <= max(tolerance * abs(value), LEAST_GRADIENT):
            break
        try:
            way = _direction(gradient, history)

            def along(t, x=x, way=way):
                f, g = seen(x + t * way)
                return f, float(g @ way)

            t = _step(along, value, float(gradient @ way), 1.0 if steps else 1.0 / np.linalg.norm(way))
            if t * np.linalg.norm(gradient) < 1e-10:
                raise SearchFailed("the step vanishes")
        except SearchFailed:
            if failed:
                break
            failed = True
            history.clear()
            continue
        new = x + t * way
        new_value, new_gradient = seen(new)
        history.appendleft((new - x, new_gradient - gradient))
        x, value, gradient, failed, steps = new, new_value, new_gradient, False, steps + 1
        values.append(value)
    return x, steps
