"""Small numerical helpers for fits inside grouped maps."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Fit:
    beta: np.ndarray
    cov: np.ndarray
    r_squared: float


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of least norm of the normal equations a x = b."""
    return np.linalg.pinv(a, hermitian=True) @ b


def normal_p(z: float) -> float:
    """Two-sided p value of a standard normal statistic."""
    return math.erfc(abs(z) / math.sqrt(2)) if math.isfinite(z) else float("nan")


def ols_hac(x: np.ndarray, y: np.ndarray, lags: int) -> Fit:
    """Least squares with a Newey-West covariance (Bartlett weights, small-sample factor n / (n - k))."""
    n, k = x.shape
    inverse = np.linalg.pinv(x.T @ x, hermitian=True)
    beta = inverse @ (x.T @ y)
    u = x * (y - x @ beta)[:, None]
    meat = u.T @ u
    for lag in range(1, min(lags, n - 1) + 1):
        cross = u[lag:].T @ u[:-lag]
        meat += (1 - lag / (lags + 1)) * (cross + cross.T)
    total = ((y - y.mean()) ** 2).sum()
    return Fit(beta, inverse @ meat @ inverse * n / max(n - k, 1), float(1 - ((y - x @ beta) ** 2).sum() / total) if total > 0 else float("nan"))


def huber(x: np.ndarray, y: np.ndarray, tuning: float = 1.345, rounds: int = 200, tolerance: float = 1e-8) -> np.ndarray:
    """Huber's M-estimate by reweighted least squares; the scale is the median absolute residual over 0.6745."""
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(rounds):
        r = y - x @ beta
        scale = np.median(np.abs(r)) / 0.6744897501960817
        if scale <= 0:
            break
        w = np.minimum(1.0, tuning * scale / np.maximum(np.abs(r), 1e-300))
        new = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        done = np.abs(new - beta).max() < tolerance
        beta = new
        if done:
            break
    return beta


def least_squares(residual: Callable[[np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Bounded Levenberg-Marquardt with a numerical Jacobian: (parameters, sum of squares)."""
    p = np.clip(np.asarray(start, float), low, high)
    r = residual(p)
    cost, damping = float(r @ r), 1e-3
    for _ in range(rounds):
        step = 1e-7 * np.maximum(np.abs(p), 1e-3)
        step = np.where(p + step > high, -step, step)
        jac = np.column_stack([(residual(p + np.eye(len(p))[k] * step[k]) - r) / step[k] for k in range(len(p))])
        a, g = jac.T @ jac, jac.T @ r
        moved = False
        for _ in range(12):
            try:
                d = np.linalg.solve(a + damping * np.diag(np.diag(a) + 1e-12), -g)
            except np.linalg.LinAlgError:
                damping *= 10
                continue
            new = np.clip(p + d, low, high)
            rn = residual(new)
            c = float(rn @ rn)
            if np.isfinite(c) and c < cost:
                moved = cost - c > 1e-14 * max(cost, 1e-300)
                p, r, cost, damping = new, rn, c, max(damping / 5, 1e-12)
                break
            damping *= 4
        if not moved:
            break
    return p, cost


def minimise(f: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Nelder-Mead simplex search."""
    n = len(start)
    points = [np.asarray(start, float)] + [np.asarray(start, float) + 0.5 * np.eye(n)[k] for k in range(n)]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[k] for k in order], [values[k] for k in order]
        if abs(values[-1] - values[0]) < 1e-12 * (1 + abs(values[0])):
            break
        mid = np.mean(points[:-1], axis=0)
        turned = mid + (mid - points[-1])
        ft = f(turned)
        if ft < values[0]:
            far = mid + 2 * (mid - points[-1])
            ff = f(far)
            points[-1], values[-1] = (far, ff) if ff < ft else (turned, ft)
        elif ft < values[-2]:
            points[-1], values[-1] = turned, ft
        else:
            near = mid + 0.5 * ((turned if ft < values[-1] else points[-1]) - mid)
            fn = f(near)
            if fn < min(ft, values[-1]):
                points[-1], values[-1] = near, fn
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    k = int(np.argmin(values))
    return points[k], values[k]
