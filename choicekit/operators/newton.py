"""Newton-Raphson for the grouped softmax likelihood; the driver solves p x p systems, the tasks do the rest."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import kernel

HALVINGS = 2.0 ** -np.arange(1, 21)


@dataclass
class Optimum:
    beta: np.ndarray
    loglik: float
    gradient: np.ndarray
    information: np.ndarray
    iterations: int
    converged: bool


def _solve(a: np.ndarray, g: np.ndarray) -> np.ndarray | None:
    """a's Newton step with a small ridge, and a larger one if that fails."""
    size = np.abs(np.diag(a)).max(initial=0.0)
    for ridge in (max(1e-8 * size, 1e-12), max(1e-8 * size, 1e-12) + 1e-4 * size):
        try:
            low = np.linalg.cholesky(a + ridge * np.eye(len(a)))
            return np.linalg.solve(low.T, np.linalg.solve(low, g))
        except np.linalg.LinAlgError:
            continue
    return None


def maximise(packed: DataFrame, p: int, keep: kernel.Columns, *, max_iter: int = 25, tol: float = 1e-6, compat: bool = False) -> Optimum:
    """One job an iteration where the full step climbs, three where it must be halved (all 20 halvings are one job).

    Converged: max|g| < tol; or the relative change of the log likelihood is below tol / 100 while
    max|g| < 1e4 tol; or the log likelihood stands still five times in a row. Every step is guarded, also the first.
    """
    beta = np.zeros(len(keep.index))
    loglik, g, info = kernel.evaluate(packed, p, beta, keep)
    before, still, converged, iterations = None, 0, False, 0
    while iterations < max_iter:
        iterations += 1
        steep = np.abs(g).max(initial=0.0)
        if steep < tol:
            converged = True
            break
        flat = max(1e-10, 4 * np.finfo(float).eps * abs(loglik))
        if before is not None:
            change = abs(loglik - before)
            if change / (abs(before) + 1e-10) < 0.01 * tol and steep < 1e4 * tol:
                converged = True
                break
            still = still + 1 if change < flat else 0
            if still >= 5:
                converged = True
                break
        before = loglik
        step = _solve(info, g)
        if step is None:
            warnings.warn("the information matrix can't be solved; the fit stops", stacklevel=3)
            break
        at = kernel.evaluate(packed, p, beta + step, keep)
        if not at[0] >= loglik - flat:
            tried = kernel.logliks(packed, p, beta, step, HALVINGS, keep)
            good = np.flatnonzero(tried >= loglik - flat)
            if not len(good) and not compat:
                warnings.warn("no step along the Newton direction climbs; the fit stops", stacklevel=3)
                break
            step = step * HALVINGS[good[0] if len(good) else -1]
            at = kernel.evaluate(packed, p, beta + step, keep)
        beta = beta + step
        loglik, g, info = at
    if not converged:
        warnings.warn(f"the fit did not converge in {iterations} iterations", stacklevel=3)
    if compat:
        info = kernel.evaluate(packed, p, beta, keep, skip_unchosen=False)[2]
    return Optimum(beta, loglik, g, info, iterations, converged)


def invert(info: np.ndarray, names: list[str]) -> np.ndarray:
    """Inverse of the information matrix, without a ridge; names the columns to blame if there is none."""
    scale = np.sqrt(np.abs(np.diag(info)))
    scale[scale == 0] = 1
    unit = info / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(unit)
    if values[0] < 1e-13 * max(values[-1], 1.0):
        blame = [names[i] for i in np.argsort(-np.abs(vectors[:, 0]))[:3]]
        raise np.linalg.LinAlgError(f"the information matrix is singular; look at {', '.join(blame)}")
    return np.linalg.inv(unit) / np.outer(scale, scale)
