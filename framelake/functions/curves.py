"""The double sigmoid of a season, as a column and in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the parameters, in order: level, rise, its rate and date, fall, its rate and date.
PARAMETERS = ("base", "a1", "k1", "t1", "a2", "k2", "t2")


def double_sigmoid(t: Column, base: float, a1: float, k1: float, t1: float, a2: float, k2: float, t2: float) -> Column:
    rise = F.lit(a1) / (F.lit(1.0) + F.exp(F.lit(-k1) * (t - F.lit(t1))))
    fall = F.lit(a2) / (F.lit(1.0) + F.exp(F.lit(-k2) * (t - F.lit(t2))))
    return F.lit(base) + rise - fall


def sigmoid_values(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return p[0] + p[1] / (1 + np.exp(-p[2] * (t - p[3]))) - p[4] / (1 + np.exp(-p[5] * (t - p[6])))


def sigmoid_slopes(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Derivatives by each parameter, as columns."""
    with np.errstate(over="ignore"):
        s1, s2 = 1 / (1 + np.exp(-p[2] * (t - p[3]))), 1 / (1 + np.exp(-p[5] * (t - p[6])))
    d1, d2 = p[1] * s1 * (1 - s1), p[4] * s2 * (1 - s2)
    return np.stack([np.ones_like(t), s1, d1 * (t - p[3]), -d1 * p[2], -s2, -d2 * (t - p[6]), d2 * p[5]], axis=1)


def fit_double_sigmoid(time, values, max_iter: int = 5000, p0=None, least: int = 10) -> dict:
    """A bounded damped least-squares fit; ``fit_status`` is success or failed.

    Fewer than ``least`` finite points, or values within 1e-6 of each other, fail.
    Returns the parameters, gup_doy and gdown_doy (their dates), gmax_doy and
    gmax_value (the curve's maximum on 1000 points) and fit_rmse.
    """
    t, y = np.asarray(time, float), np.asarray(values, float)
    ok = np.isfinite(t) & np.isfinite(y)
    t, y = t[ok], y[ok]
    order = np.argsort(t, kind="stable")
    t, y = t[order], y[order]
    none = dict.fromkeys((*PARAMETERS, "gup_doy", "gdown_doy", "gmax_doy", "gmax_value", "fit_rmse"), float("nan"))
    if len(t) < least or np.ptp(y) < 1e-6:
        return none | {"fit_status": "failed"}
    low = np.array([0, 0, 0.001, t[0], 0, 0.001, t[0]])
    high = np.array([1, 1, 1, t[-1], 1, 1, t[-1]])
    if p0 is None:
        slope = np.convolve(np.gradient(y, t) if np.all(np.diff(t) > 0) else np.gradient(y), np.ones(5) / 5, "same")
        up, down = sorted((t[slope.argmax()], t[slope.argmin()]))
        p0 = [y.min(), 1.2 * np.ptp(y), 0.1, up, 1.2 * np.ptp(y), 0.1, down]
    p = np.clip(np.asarray(p0, float), low + 1e-6, high - 1e-6)
    error = sigmoid_values(t, p) - y
    cost, damp = error @ error, 1e-3
    for _ in range(min(max_iter, 500)):
        j = sigmoid_slopes(t, p)
        free = ~(((p <= low) & (j.T @ error > 0)) | ((p >= high) & (j.T @ error < 0)))
        a = j[:, free].T @ j[:, free]
        try:
            step = np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), -(j[:, free].T @ error))
        except np.linalg.LinAlgError:
            damp *= 10
            continue
        new = p.copy()
        new[free] = np.clip(p[free] + step, low[free], high[free])
        new_error = sigmoid_values(t, new) - y
        new_cost = new_error @ new_error
        if new_cost < cost:
            small = cost - new_cost <= 1e-12 * max(cost, 1e-12)
            p, error, cost, damp = new, new_error, new_cost, max(damp / 5, 1e-12)
            if small:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    grid = np.linspace(t[0], t[-1], 1000)
    curve = sigmoid_values(grid, p)
    return dict(zip(PARAMETERS, map(float, p), strict=True)) | {
        "gup_doy": float(p[3]), "gdown_doy": float(p[6]), "gmax_doy": float(grid[curve.argmax()]), "gmax_value": float(curve.max()),
        "fit_rmse": float(np.sqrt(cost / len(t))), "fit_status": "success",
    }
