"""One Markov chain over one component of a model, run inside a task."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np

from ..functions.gig import TINY, draw_gig
from .backends import guard
from .spec import Block, Controls, Residual

REFRESH = 100


@dataclass
class Problem:
    """What a chain needs: a backend on the working scale, and who belongs to which block."""

    backend: Any
    blocks: list[Block]
    block_of: np.ndarray  # block number of each predictor
    residual: Residual
    df: int
    index: np.ndarray  # predictors' numbers in the whole model
    scale: np.ndarray  # coefficients of the data are those of the working scale over it
    block_index: list[int]  # blocks' numbers in the whole model
    all_blocks: int
    x_means: np.ndarray  # of the working scale
    lead: bool = True  # draws what only one component may: the intercept's noise


@dataclass
class State:
    """A block's hyper-parameters."""

    var: float = 1.0
    pi: Any = None
    tau: float = 1.0
    zeta: float = 1.0
    psi: Any = None
    xi: Any = None


def _start(b: Block, p: int) -> State:
    s = State()
    if b.model in ("Normal", "SpikeSlab", "SpikeMultiSlab"):
        s.var = b.var if b.var is not None else b.scale / (b.shape + 1)
    if b.model == "SpikeSlab":
        s.pi = b.pi[0] / sum(b.pi)
    elif b.model == "SpikeMultiSlab":
        s.pi = np.array(b.alpha) / sum(b.alpha)
    elif b.model == "GlobalLocal":
        s.tau = b.global_var if b.global_var is not None else b.global_scale**2
        s.psi, s.xi = np.ones(p), np.ones(p)
    return s


def inverse_gamma(rng, shape: float, rate: float) -> float:
    return rate / max(rng.gamma(shape), TINY)


def _spike_draw(rng, pi, var, v, m):
    """Included or not, and the coefficient, given the slab's conditional mean m and variance v."""
    eps = np.finfo(float).eps
    pi = min(max(pi, eps), 1 - eps)
    odds = math.log(pi) - math.log1p(-pi) + 0.5 * math.log(v / var) + m * m / (2 * v)
    prob = 1 / (1 + math.exp(-odds)) if odds >= 0 else math.exp(max(odds, -700)) / (1 + math.exp(max(odds, -700)))
    return rng.random() < prob


def chain(p: Problem, c: Controls, rng: np.random.Generator, noise: Callable[[int, int], float] | None = None) -> Iterator[dict]:
    """Yield each kept draw.  ``noise(iteration, j)`` replaces standard normal draws of coefficients."""
    be, blocks = p.backend, p.blocks
    k = len(be.diag)
    members = [np.flatnonzero(p.block_of == b) for b in range(len(blocks))]
    theta, included, component = np.zeros(k), np.ones(k, bool), np.zeros(k, np.int64)
    states = [_start(b, len(m)) for b, m in zip(blocks, members, strict=True)]
    place = np.zeros(k, np.int64)
    for m in members:
        place[m] = np.arange(len(m))
    fixed_sigma = p.residual.var is not None
    sigma2 = p.residual.var if fixed_sigma else p.residual.scale / (p.residual.shape + 1)
    be.reset(theta)
    sse = be.y2
    kept = c.kept()
    block_of, diag = p.block_of.tolist(), be.diag.tolist()
    joint = [b for b, x in enumerate(blocks) if c.joint and x.model in ("Normal", "Fixed", "GlobalLocal")]
    grams = {b: be.part(members[b]) for b in joint}
    for it in range(1, c.iterations + 1):
        if noise is None:
            normals = rng.standard_normal(k)
        else:
            normals = [noise(it, j) for j in range(k)]
        for b in joint:
            _joint_draw(be, grams[b], theta, members[b], _variances(blocks[b], states[b], len(members[b])), sigma2, normals)
        if joint:
            be.reset(theta)
            sse = be.residual(theta)
        for j in range(k):
            b = block_of[j]
            if b in joint:
                continue
            blk, st, d, old = blocks[b], states[b], diag[j], theta[j]
            t = be.rhs(j) + d * old
            model = blk.model
            if model == "SpikeMultiSlab":
                new, component[j] = _multi_draw(rng, blk, st, d, t, sigma2, normals[j])
                included[j] = component[j] > 0
            else:
                prior = 0.0 if model == "Fixed" else 1 / (st.var if model != "GlobalLocal" else max(st.tau * st.psi[place[j]], TINY))
                v = 1 / (d / sigma2 + prior)
                m = v * t / sigma2
                if model == "SpikeSlab" and not _spike_draw(rng, st.pi, st.var, v, m):
                    new, included[j] = 0.0, False
                else:
                    new, included[j] = m + math.sqrt(v) * normals[j], True
            if new != old:
                sse += -2 * (new - old) * t + (new * new - old * old) * d
                be.move(j, new - old)
                theta[j] = new
        if be.streaming:
            be.reset(theta)
        if it % REFRESH == 0:
            be.reset(theta)
            sse = be.residual(theta)
        for b, (blk, st) in enumerate(zip(blocks, states, strict=True)):
            _update(rng, blk, st, theta[members[b]], included[members[b]], component[members[b]])
        if not fixed_sigma:
            sse = guard(sse, be.y2, "a residual sum of squares")
            sigma2 = inverse_gamma(rng, p.residual.shape + p.df / 2, p.residual.scale + sse / 2)
        if c.verbose and it % max(1, c.iterations // 10) == 0:
            print(f"iteration {it} of {c.iterations}", file=sys.stderr, flush=True)
        if it in kept:
            yield _draw(p, c, rng, (it - c.burnin - 1) // c.thin, theta, included, component, states, sigma2, members)


def _variances(blk: Block, st: State, p: int):
    if blk.model == "Fixed":
        return None
    return np.full(p, st.var) if blk.model == "Normal" else np.maximum(st.tau * st.psi, TINY)


def _joint_draw(be, gram, theta, idx, var, sigma2, normals):
    """All of a block's coefficients at once, given the others; ``gram`` is the block's own matrix."""
    t = be.g[idx] - be.product(theta)[idx] + gram @ theta[idx]
    a = gram / sigma2
    if var is not None:
        a[np.diag_indices_from(a)] += 1 / var
    low = np.linalg.cholesky(a)
    # solves with the one triangular factor
    theta[idx] = solve_triangular(low, solve_triangular(low, t / sigma2) + np.asarray(normals)[idx], transposed=True)


def solve_triangular(low: np.ndarray, b: np.ndarray, transposed: bool = False) -> np.ndarray:
    """x of ``low x = b``, or of ``low' x = b``, by blocks of rows."""
    n, x, step = len(b), np.array(b, float), 64
    starts = range(0, n, step)
    for i in reversed(starts) if transposed else starts:
        j = min(i + step, n)
        if transposed:
            x[i:j] = np.linalg.solve(low[i:j, i:j].T, x[i:j] - low[j:, i:j].T @ x[j:])
        else:
            x[i:j] = np.linalg.solve(low[i:j, i:j], x[i:j] - low[i:j, :i] @ x[:i])
    return x


def _multi_draw(rng, blk: Block, st: State, d, t, sigma2, z):
    n = len(blk.gamma)
    logs, means, vs = [math.log(max(st.pi[0], TINY))], [0.0] * n, [0.0] * n
    for i in range(1, n):
        prior = blk.gamma[i] * st.var
        v = 1 / (d / sigma2 + 1 / prior)
        m = v * t / sigma2
        means[i], vs[i] = m, v
        logs.append(math.log(max(st.pi[i], TINY)) + 0.5 * math.log(v / prior) + m * m / (2 * v))
    top = max(logs)
    w = [math.exp(x - top) for x in logs]
    u, c = rng.random() * sum(w), 0
    while c < n - 1 and u >= w[c]:
        u -= w[c]
        c += 1
    return (0.0, 0) if c == 0 else (means[c] + math.sqrt(vs[c]) * z, c)


def _update(rng, blk: Block, st: State, theta, included, component) -> None:
    p = len(theta)
    if blk.model == "Normal":
        if blk.var is None:
            st.var = inverse_gamma(rng, blk.shape + p / 2, blk.scale + float(theta @ theta) / 2)
    elif blk.model == "SpikeSlab":
        m = int(included.sum())
        st.pi = rng.beta(blk.pi[0] + m, blk.pi[1] + p - m)
        if blk.var is None:
            st.var = inverse_gamma(rng, blk.shape + m / 2, blk.scale + float(theta[included] @ theta[included]) / 2)
    elif blk.model == "SpikeMultiSlab":
        counts = np.bincount(component, minlength=len(blk.gamma))
        g = np.maximum(rng.gamma(np.array(blk.alpha) + counts), TINY)
        st.pi = g / g.sum()
        if blk.var is None:
            on = component > 0
            st.var = inverse_gamma(rng, blk.shape + on.sum() / 2, blk.scale + float((theta[on] ** 2 / np.array(blk.gamma)[component[on]]).sum()) / 2)
    elif blk.model == "GlobalLocal":
        a, b = blk.local_shape
        chi = np.maximum(theta**2 / max(st.tau, TINY), TINY)
        st.psi = np.maximum(draw_gig(a - 0.5, chi, 2 * st.xi, rng), TINY)
        st.xi = np.maximum(rng.gamma(a + b, size=p) / (1 + st.psi), TINY)
        if blk.global_var is None:
            st.tau = max(inverse_gamma(rng, (p + 1) / 2, 1 / st.zeta + float((theta**2 / st.psi).sum()) / 2), TINY)
            st.zeta = max(inverse_gamma(rng, 1.0, 1 / blk.global_scale**2 + 1 / st.tau), TINY)


def _draw(p: Problem, c: Controls, rng, number, theta, included, component, states, sigma2, members) -> dict:
    hyper, pve = {}, {}
    for blk, st in zip(p.blocks, states, strict=True):
        if blk.model in ("Normal", "SpikeSlab", "SpikeMultiSlab"):
            hyper[f"{blk.name}::var"] = float(st.var)
        if blk.model == "SpikeSlab":
            hyper[f"{blk.name}::pi"] = float(st.pi)
        elif blk.model == "SpikeMultiSlab":
            hyper |= {f"{blk.name}::pi[{i}]": float(x) for i, x in enumerate(st.pi)}
        elif blk.model == "GlobalLocal":
            hyper[f"{blk.name}::global_var"] = float(st.tau)
    own, along, total = np.zeros(p.all_blocks), np.zeros(p.all_blocks), 0.0
    if c.pve:
        g = p.backend.product(theta)
        total = float(theta @ g)
        scale = max(abs(total), p.backend.y2)
        each = p.backend.quadratics(theta, p.block_of, len(members)) if len(members) > 1 else [total]
        for i, m, x in zip(p.block_index, members, each, strict=True):
            own[i] = guard(x, scale, "a block's signal")
            along[i] = float(theta[m] @ g[m])
        total = guard(total, scale, "the signal")
    local = np.full(len(theta), np.nan)
    for st, m, blk in zip(states, members, p.blocks, strict=True):
        if blk.model == "GlobalLocal":
            local[m] = st.psi
    return {
        "draw": number, "residual_var": float(sigma2), "theta": theta / p.scale, "included": included.copy(), "component": component.copy(), "local_var": local, "hyper": hyper,
        "own": own, "along": along, "signal": total, "x_part": float(p.x_means @ theta), "noise": rng.standard_normal() if p.lead else 0.0,
    }


class Online:
    """Running means and squared deviations (and, for blocks, products) of a chain's draws."""

    def __init__(self):
        self.n = 0

    def add(self, x: np.ndarray) -> None:
        if not self.n:
            self.mean, self.m2 = np.zeros(len(x)), np.zeros(len(x))
        self.n += 1
        d = x - self.mean
        self.mean += d / self.n
        self.m2 += d * (x - self.mean)


class OnlineCov(Online):
    def add(self, x: np.ndarray) -> None:
        if not self.n:
            self.mean, self.m2 = np.zeros(len(x)), np.zeros((len(x), len(x)))
        self.n += 1
        d = x - self.mean
        self.mean += d / self.n
        self.m2 += np.outer(d, x - self.mean)
