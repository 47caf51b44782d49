"""The sampler against closed forms, enumeration, analytic moments, and itself over representations."""

import math

import numpy as np
import pytest

from bayesmill.functions.gig import draw_gig
from bayesmill.functions.normal import mixture_quantile, normal_cdf
from bayesmill.plans.backends import Blocks, Correlation, Dense, LowRank, Sparse, guard
from bayesmill.plans.kernel import Online, OnlineCov, Problem, chain
from bayesmill.plans.spec import Block, Controls, Residual, parse_blocks


def problem(be, blocks, block_of=None, residual=None, df=39):
    k = len(be.diag)
    block_of = np.zeros(k, int) if block_of is None else np.array(block_of)
    return Problem(be, blocks, block_of, residual or Residual(var=1.0), df, np.arange(k), np.ones(k), list(range(len(blocks))), len(blocks), np.zeros(k))


def data(seed=0, n=40, p=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) @ (np.eye(p) + 0.3)
    x -= x.mean(axis=0)
    y = x @ np.linspace(1, -1, p) + rng.normal(size=n)
    y -= y.mean()
    return x, y


def thetas(p, seed=1, **kw):
    c = Controls(**({"iterations": 6000, "burnin": 500} | kw))
    return list(chain(p, c, np.random.default_rng(seed)))


@pytest.mark.parametrize("joint", [False, True])
def test_normal_with_known_variances(joint):
    x, y = data()
    g = x.T @ x
    d = np.array([r["theta"] for r in thetas(problem(Dense(g, x.T @ y, y @ y), [Block("a", "Normal", var=0.5)]), joint=joint)])
    cov = np.linalg.inv(g + 2 * np.eye(4))
    assert np.allclose(d.mean(axis=0), cov @ x.T @ y, atol=0.03)
    assert np.allclose(np.cov(d.T), cov, atol=0.1 * cov.max())


def test_fixed_is_least_squares():
    x, y = data(1)
    g = x.T @ x
    d = np.array([r["theta"] for r in thetas(problem(Dense(g, x.T @ y, y @ y), [Block("a", "Fixed")]))])
    assert np.allclose(d.mean(axis=0), np.linalg.solve(g, x.T @ y), atol=0.03)
    assert np.allclose(d.var(axis=0), np.diag(np.linalg.inv(g)), rtol=0.15)


def test_residual_variance():
    x, y = data(2, n=200)
    d = [r["residual_var"] for r in thetas(problem(Dense(x.T @ x, x.T @ y, y @ y), [Block("a", "Fixed")], residual=Residual(shape=2.0, scale=1.0), df=199))]
    b = np.linalg.solve(x.T @ x, x.T @ y)
    rate = 1 + ((y - x @ b) ** 2).sum() / 2
    assert np.mean(d) == pytest.approx(rate / (2 + (199 - 4) / 2 - 1), rel=0.02)  # coefficients integrated out


def test_spike_slab_by_enumeration():
    x, y = data(3, n=30, p=2)
    y = y * 0.3
    g, r, v = x.T @ x, x.T @ y, 0.4
    logs = {}
    for m in range(4):
        on = [j for j in range(2) if m >> j & 1]
        a = g[np.ix_(on, on)] + np.eye(len(on)) / v
        fit = 0.5 * r[on] @ np.linalg.solve(a, r[on]) - 0.5 * (np.linalg.slogdet(a)[1] + len(on) * math.log(v)) if on else 0.0
        logs[m] = fit + math.lgamma(2 + len(on)) + math.lgamma(3 + 2 - len(on))  # pi ~ Beta(2, 3)
    w = {m: math.exp(z - max(logs.values())) for m, z in logs.items()}
    want = [sum(w[m] for m in w if m >> j & 1) / sum(w.values()) for j in range(2)]
    d = np.array([s["included"] for s in thetas(problem(Dense(g, r, y @ y), [Block("a", "SpikeSlab", var=v, pi=(2.0, 3.0))]), iterations=12000)])
    assert np.allclose(d.mean(axis=0), want, atol=0.03)


def test_multi_slab_reduces_to_spike_slab():
    x, y = data(3, n=30, p=2)
    be = lambda: Dense(x.T @ x, 0.3 * x.T @ y, 0.09 * y @ y)
    a = np.array([s["included"] for s in thetas(problem(be(), [Block("a", "SpikeSlab", var=0.4, pi=(3.0, 2.0))]), iterations=9000)])
    d = thetas(problem(be(), [Block("a", "SpikeMultiSlab", var=0.4, gamma=(0.0, 1.0), alpha=(2.0, 3.0))]), iterations=9000)
    assert np.allclose(a.mean(axis=0), np.mean([s["included"] for s in d], axis=0), atol=0.04)
    assert all((s["component"] > 0).tolist() == s["included"].tolist() for s in d[:50])


def bessel_k(v, x):
    t = np.linspace(0, 30, 200_001)
    f = np.exp(-x * np.cosh(np.minimum(t, 12)) + x) * np.cosh(v * t) * (t < 12)
    return np.trapezoid(f, t)  # times exp(-x)


@pytest.mark.parametrize("lam", [-2.5, -0.5, 0.0, 0.2, 0.8, 1.0, 3.0, 12.0])
@pytest.mark.parametrize("chi,psi", [(0.01, 0.01), (0.25, 1.0), (4.0, 4.0), (2.0, 3.0), (1e-4, 50.0), (80.0, 60.0)])
def test_gig_moments(lam, chi, psi):
    x = draw_gig(np.full(40_000, lam), chi, psi, np.random.default_rng(3))
    w = math.sqrt(chi * psi)
    ratio = bessel_k(lam + 1, w) / bessel_k(lam, w)
    mean = math.sqrt(chi / psi) * ratio
    var = chi / psi * (bessel_k(lam + 2, w) / bessel_k(lam, w) - ratio**2)
    assert x.mean() == pytest.approx(mean, abs=6 * math.sqrt(var / 40_000) + 1e-3 * mean)


def test_gig_limits():
    rng = np.random.default_rng(0)
    assert draw_gig(np.full(50_000, 2.0), 0.0, 4.0, rng).mean() == pytest.approx(1.0, rel=0.03)
    assert (1 / draw_gig(np.full(50_000, -2.0), 4.0, 0.0, rng)).mean() == pytest.approx(1.0, rel=0.03)
    for lam, chi, psi in [(0.0, 1e-300, 1.0), (-0.5, 1e-308, 1e-300), (0.5, 1e300, 1e-300), (0.0, 1e-200, 1e200)]:
        x = draw_gig(np.full(100, lam), chi, psi, rng)
        assert np.isfinite(x).all() and (x > 0).all()
    for bad in [(0.0, 0.0, 1.0), (-1.0, 0.0, 1.0), (1.0, 1.0, 0.0), (1.0, -1.0, 1.0), (math.nan, 1.0, 1.0)]:
        with pytest.raises(ValueError):
            draw_gig(*bad, rng)


def test_global_local_prior_only():
    be = Dense(np.zeros((400, 400)), np.zeros(400), 0.0)
    p = problem(be, [Block("a", "GlobalLocal", local_shape=(1.0, 2.0), global_var=1.0)], df=1)
    psi = np.concatenate([r["local_var"] for r in thetas(p, iterations=400, burnin=100)])
    # beta-prime(1, 2): P(psi <= 1) = 1 - (1/2)**2
    assert (psi <= 1).mean() == pytest.approx(0.75, abs=0.02)


def lower(m):
    return [(np.flatnonzero(m[j + 1 :, j]) + j + 1, m[j + 1 :, j][m[j + 1 :, j] != 0]) for j in range(len(m))]


@pytest.mark.parametrize("seed", range(3))
def test_representations_agree_draw_for_draw(seed):
    rng = np.random.default_rng(seed)
    xs = [rng.normal(size=(40, k)) for k in (3, 2)]
    xs = [x - x.mean(axis=0) for x in xs]
    y = rng.normal(size=40)
    y -= y.mean()
    gs = [x.T @ x for x in xs]
    full = np.zeros((5, 5))
    full[:3, :3], full[3:, 3:] = gs
    g = np.concatenate([x.T @ y for x in xs])
    y2 = float(y @ y) * 2
    c = rng.normal(size=5) * 0.1
    cols = [(np.arange(5), full[:, j] + c[j] * c) for j in range(5)]
    s = np.sqrt(np.diag(full))
    rs = [m / np.outer(np.sqrt(np.diag(m)), np.sqrt(np.diag(m))) for m in gs]
    eig = [np.linalg.eigh(m) for m in gs]
    factors = [np.sqrt(lam)[:, None] * u.T for lam, u in eig]
    targets = [u.T @ g[a:b] / np.sqrt(lam) for (lam, u), (a, b) in zip(eig, [(0, 3), (3, 5)], strict=True)]
    backs = [
        Dense(full, g, y2), Blocks(gs, g, y2), Sparse(cols, g, y2, c), Correlation([(len(r), lower(r)) for r in rs], s, g, y2),
        LowRank(factors, targets, y2 - sum(float(w @ w) for w in targets)),
    ]
    blocks = [Block("a", "SpikeSlab", shape=2.0, scale=1.0, pi=(1.0, 1.0)), Block("b", "GlobalLocal", local_shape=(1.0, 0.5), global_scale=1.0)]
    runs = [thetas(problem(b, blocks, [0, 1, 0, 1, 1], Residual(shape=2.0, scale=1.0)), iterations=230, burnin=10, pve=True) for b in backs]
    for r in runs[1:]:
        for a, b in zip(runs[0], r, strict=True):
            assert np.allclose(a["theta"], b["theta"], atol=1e-8) and a["residual_var"] == pytest.approx(b["residual_var"], rel=1e-8)
            assert a["signal"] == pytest.approx(b["signal"], rel=1e-6, abs=1e-8) and np.allclose(a["own"], b["own"], atol=1e-6)


def test_correlation_shrink():
    m = np.array([[1, 0.5, 0], [0.5, 1, -0.3], [0, -0.3, 1]])
    s = np.array([2.0, 1.0, 3.0])
    be = Correlation([(3, lower(m))], s, np.ones(3), 5.0, 0.2)
    full = np.outer(s, s) * (0.8 * m + 0.2 * np.eye(3))
    t = np.array([0.3, -1, 2])
    assert np.allclose(be.product(t), full @ t)
    be.reset(t)
    be.move(1, 0.7)
    assert np.allclose([be.rhs(j) for j in range(3)], 1 - full @ (t + [0, 0.7, 0]))


def test_pve_identities():
    x, y = data(4)
    p = problem(Dense(x.T @ x, x.T @ y, y @ y), [Block("a", "Normal", var=1.0), Block("b", "Fixed")], [0, 0, 1, 1])
    for r in thetas(p, iterations=60, burnin=10, pve=True):
        f = x @ r["theta"]
        fa = x[:, :2] @ r["theta"][:2]
        assert r["signal"] == pytest.approx(f @ f, rel=1e-12) and r["own"][0] == pytest.approx(fa @ fa, rel=1e-12)
        assert r["along"][0] == pytest.approx(fa @ f, rel=1e-10) and r["along"].sum() == pytest.approx(r["signal"], rel=1e-10)


def test_online_moments():
    x = np.random.default_rng(0).normal(size=(50, 3)) + 1e9
    o, c = Online(), OnlineCov()
    for r in x:
        o.add(r)
        c.add(r)
    assert np.allclose(o.mean, x.mean(axis=0)) and np.allclose(o.m2 / 49, x.var(axis=0, ddof=1), rtol=1e-6)
    assert np.allclose(c.m2 / 49, np.cov(x.T), atol=1e-6)


def test_guard():
    assert guard(-1e-12, 1.0, "x") == 0.0 and guard(2.0, 1.0, "x") == 2.0
    for bad in (-1.0, math.nan, math.inf):
        with pytest.raises(ValueError):
            guard(bad, 1.0, "x")


def test_same_seed_same_draws():
    x, y = data(5)
    p = problem(Dense(x.T @ x, x.T @ y, y @ y), [Block("a", "SpikeSlab", shape=2.0, scale=1.0, pi=(1.0, 1.0))])
    a, b = (np.array([r["theta"] for r in thetas(p, seed=9, iterations=50, burnin=10)]) for _ in range(2))
    assert (a == b).all() and not (a == np.array([r["theta"] for r in thetas(p, seed=8, iterations=50, burnin=10)])).all()


def test_normal_functions():
    x = np.linspace(-10, 10, 1001)
    assert np.allclose(normal_cdf(x), [0.5 * math.erfc(-v / math.sqrt(2)) for v in x], atol=1e-12)
    rng = np.random.default_rng(0)
    m, s = rng.normal(size=(5, 30)) * 3, rng.uniform(0.1, 2, 30)
    for q in (0.025, 0.5, 0.975):
        at = mixture_quantile(m, s, q)
        assert np.allclose(normal_cdf((at[:, None] - m) / s).mean(axis=1), q, atol=1e-9)


def test_storage_kinds_give_equal_draws():
    """Blocks kept dense, sparse and as one triangle, draw for draw, prior blocks crossing Gram blocks."""
    rng = np.random.default_rng(0)
    mats = []
    for n in (4, 3, 5):
        x = rng.normal(size=(30, n))
        m = x.T @ x
        m[abs(m) < 3] = 0
        mats.append(m + 10 * np.eye(n))
    g = rng.normal(size=12) * 20
    block_of = np.array([0, 1] * 6)
    blocks = parse_blocks([{"model": "Normal", "indices": list(range(0, 12, 2))}, {"model": "SpikeSlab", "indices": list(range(1, 12, 2))}], "indices")
    out = []
    for how in (["dense"] * 3, ["sparse"] * 3, ["lower"] * 3, ["lower", "dense", "sparse"]):
        be = Blocks(mats, g, 500.0, how)
        t = rng.normal(size=12)
        whole = np.zeros((12, 12))
        for m, a in zip(mats, (0, 4, 7), strict=True):
            whole[a : a + len(m), a : a + len(m)] = m
        assert np.allclose(be.product(t), whole @ t) and np.allclose(be.part([1, 5, 2, 11]), whole[np.ix_([1, 5, 2, 11], [1, 5, 2, 11])])
        p = Problem(be, blocks, block_of, Residual(shape=3.0, scale=2.0), 40, np.arange(12), np.ones(12), [0, 1], 2, np.zeros(12))
        out.append([(*d["theta"], d["residual_var"], *d["own"], *d["along"]) for d in chain(p, Controls(iterations=150, burnin=20, pve=True), np.random.default_rng(3))])
    for other in out[1:]:
        assert np.allclose(out[0], other, atol=1e-8)


def test_quadratics_of_groups_in_one_pass():
    rng = np.random.default_rng(1)
    r = np.corrcoef(rng.normal(size=(20, 6)).T)
    s, g, t = rng.random(6) + 0.5, rng.normal(size=6), rng.normal(size=6)
    lower = [(np.arange(j + 1, 6), r[j + 1 :, j]) for j in range(6)]
    c = Correlation([(6, lower)], s, g, 10.0, 0.2)
    full = np.outer(s, s) * (0.8 * r + 0.2 * np.eye(6))
    groups = np.array([0, 1, 0, 2, 1, 0])
    assert np.allclose(c.product(t), full @ t)
    assert np.allclose(c.quadratics(t, groups, 3), Dense(full, g, 10.0).quadratics(t, groups, 3))
