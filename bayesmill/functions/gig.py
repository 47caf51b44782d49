"""Generalised inverse Gaussian draws, density x**(l-1) exp(-(c/x + w x)/2).

The rejection method of Devroye (2014) on the logarithmic scale: the density of
log x is log-concave, and one three-part envelope has a bounded rejection rate
for all parameters.  All arguments may be arrays; draws are vectorised.
"""

from __future__ import annotations

import numpy as np

TINY = np.finfo(float).tiny


def _psi(x, alpha, lam):
    return -alpha * (np.cosh(x) - 1) - lam * (np.expm1(x) - x)


def _slope(x, alpha, lam):
    return -alpha * np.sinh(x) - lam * np.expm1(x)


def _standard(lam: np.ndarray, omega: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """log x - log(mode-like centre) for lam >= 0, c = w = omega > 0."""
    alpha = omega**2 / (np.sqrt(omega**2 + lam**2) + lam)
    with np.errstate(divide="ignore", over="ignore"):
        up, down = -_psi(1.0, alpha, lam), -_psi(-1.0, alpha, lam)
        t = np.where(up > 2, np.sqrt(2 / (alpha + lam)), np.where(up < 0.5, np.log(4 / (alpha + 2 * lam)), 1.0))
        s_low = np.minimum(1 / lam, np.log1p(1 / alpha + np.sqrt(1 / alpha**2 + 2 / alpha)))
        s = np.where(down > 2, np.sqrt(4 / (alpha * np.cosh(1) + lam)), np.where(down < 0.5, s_low, 1.0))
    eta, zeta = -_psi(t, alpha, lam), -_slope(t, alpha, lam)
    theta, xi = -_psi(-s, alpha, lam), _slope(-s, alpha, lam)
    p, r = 1 / xi, 1 / zeta
    right, left = t - r * eta, s - p * theta
    q = right + left
    out, todo = np.empty(len(lam)), np.arange(len(lam))
    while len(todo):
        u, v, w = 1 - rng.random((3, len(todo)))
        pt, qt, rt = p[todo], q[todo], r[todo]
        total = pt + qt + rt
        x = np.where(u < qt / total, -left[todo] + qt * v, np.where(u < (qt + rt) / total, right[todo] - rt * np.log(v), -left[todo] + pt * np.log(v)))
        hat = np.where(x > right[todo], -eta[todo] - zeta[todo] * (x - t[todo]), np.where(x < -left[todo], -theta[todo] + xi[todo] * (x + s[todo]), 0.0))
        with np.errstate(over="ignore"):
            ok = np.log(w) + hat <= _psi(x, alpha[todo], lam[todo])
        out[todo[ok]] = x[ok]
        todo = todo[~ok]
    return out


def draw_gig(lam, chi, psi, rng: np.random.Generator) -> np.ndarray:
    """One draw for each triple.  chi = 0 needs lam > 0 (gamma), psi = 0 needs lam < 0 (inverse gamma)."""
    lam, chi, psi = (np.atleast_1d(a).astype(float) for a in np.broadcast_arrays(lam, chi, psi))
    if not (np.isfinite(lam).all() and (chi >= 0).all() and (psi >= 0).all()):
        raise ValueError("invalid parameters")
    out = np.empty(len(lam))
    # the root of the product, without under- or overflow of the product itself
    omega = np.sqrt(chi) * np.sqrt(psi)
    gamma, inverse = (chi == 0) | (omega < 1e-150) & (lam > 0), (psi == 0) | (omega < 1e-150) & (lam < 0)
    if ((chi == 0) & (lam <= 0) | (psi == 0) & (lam >= 0)).any():
        raise ValueError("no such distribution")
    inverse &= ~gamma
    rest = ~(gamma | inverse)
    if gamma.any():
        out[gamma] = rng.gamma(lam[gamma]) * 2 / psi[gamma]
    if inverse.any():
        out[inverse] = chi[inverse] / 2 / np.maximum(rng.gamma(-lam[inverse]), TINY)
    if rest.any():
        size, w = np.abs(lam[rest]), np.maximum(omega[rest], 1e-150)
        x = _standard(size, w, rng) + np.log(size + np.hypot(size, w)) - np.log(w)
        log = np.where(lam[rest] < 0, -x, x) + 0.5 * (np.log(chi[rest]) - np.log(psi[rest]))
        out[rest] = np.exp(np.clip(log, np.log(TINY), 709.0))
    return np.maximum(out, TINY)
