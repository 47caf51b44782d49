"""Normal distribution functions that neither Spark nor numpy has."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np

_EDGE, _STEPS = 9, 256  # beyond the edge the tail is below 2e-19


@functools.lru_cache(1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(-_EDGE * _STEPS, _EDGE * _STEPS + 2) / _STEPS
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    return cdf, np.exp(-x * x / 2) / math.sqrt(2 * math.pi) / _STEPS


def normal_cdf(x) -> np.ndarray:
    """Cubic interpolation of a fine table of values and slopes; the error is below 1e-12."""
    cdf, slope = _table()
    at = (np.clip(np.asarray(x, float), -_EDGE, _EDGE) + _EDGE) * _STEPS
    k = at.astype(np.int64)
    t = at - k
    a, b, u, v = cdf[k], cdf[k + 1], slope[k], slope[k + 1]
    return a + t * (u + t * (3 * (b - a) - 2 * u - v + t * (2 * (a - b) + u + v)))


def mixture_quantile(means: np.ndarray, sds: np.ndarray, prob: float, tolerance: float = 1e-10) -> np.ndarray:
    """Quantile of an equal-weight normal mixture for each row of ``means`` (row, draw): Newton's steps inside a bracket.

    ``sds`` has one value for each draw.
    """
    z = NormalDist().inv_cdf(prob)
    each = means + z * sds
    low, high = each.min(axis=1), each.max(axis=1)  # the mixture's quantile lies among those of its parts
    # begin at the quantile of one normal with the mixture's mean and variance
    x = np.clip(means.mean(axis=1) + z * np.sqrt(means.var(axis=1) + (sds**2).mean()), low, high)
    inverse, height = 1 / sds, 1 / (sds * math.sqrt(2 * math.pi)) / len(sds)
    for _ in range(100):
        z = (x[:, None] - means) * inverse
        gap = normal_cdf(z).mean(axis=1) - prob
        low, high = np.where(gap < 0, x, low), np.where(gap < 0, high, x)
        with np.errstate(divide="ignore", over="ignore"):
            new = x - gap / (np.exp(-0.5 * z * z) @ height)
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        done = (abs(new - x) <= tolerance * np.maximum(1, abs(x))).all()
        x = new
        if done:
            break
    return x
